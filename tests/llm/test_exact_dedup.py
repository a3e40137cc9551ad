import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeshift.llm import exact_dedup


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, n in norm:
        groups[n].append(i)
    out = []
    for i, n in norm:
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


EDGES = [(5, None), (4, ""), (None, " "), (6, "\t\n"), (1, "a b"), (2, "a \n b"), (2, "a\x0bb"), (3, "a b"),
         (9, "x" * 50000), (8, "x" * 50000), (None, "only null ids"), (None, "only  null ids"), (7, "a b "), (7, "a b ")]


@pytest.mark.parametrize("capacity", [1, 1000])
def test_against_brute_force(frame, texts, capacity):
    rows = EDGES + texts
    got = exact_dedup.exact_groups(frame(rows), capacity=capacity).drop("stamp").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_directory_doubles_until_buckets_fit(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.directory(entries, capacity=40)
    cell = exact_dedup._prefix(F.col("key"), exact_dedup.MAX_DEPTH)
    load = entries.withColumn("cell", cell).join(leaves, "cell").groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in load) == 3000
    assert max(r["count"] for r in load) <= 40
    # A bucket's buddy region together would be overfull: no needless split.
    by = {r.bucket: r["count"] for r in load}
    assert all(by[b] + by.get(b ^ 1, 41) > 40 for b in by if b > 1)


def test_chains_of_one_key(frame, texts):
    """Keys that collide: the bytes decide, within the bucket's chain."""
    rows = EDGES + texts
    for key in (lambda n: F.length(n).cast("long") % 7, lambda n: F.lit(5).cast("long")):
        got = exact_dedup.exact_groups(frame(rows), capacity=3, key=key).drop("stamp").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    docs = frame(rows)
    keys = exact_dedup.row_keys(docs, "doc_id", "text", lambda n: F.lit(5).cast("long"))
    slots = exact_dedup.directory(keys.select("key").distinct(), 3).select("cell", "bucket")
    index = exact_dedup.build_index(docs, slots, "doc_id", "text", lambda n: F.lit(5).cast("long"))
    chains = sorted(r.chain for r in index.collect())
    assert chains == list(range(len({r[4] for r in brute(rows)})))


def test_rows_find_their_entries_through_the_directory(frame, texts, monkeypatch):
    """A directory that lacks half of its cells leaves their rows without entries."""
    whole = exact_dedup.directory
    want = brute(texts)
    assert len(exact_dedup.exact_groups(frame(texts), capacity=10).collect()) == len(want)
    monkeypatch.setattr(exact_dedup, "directory", lambda e, c: whole(e, c).where("cell % 2 = 0"))
    got = exact_dedup.exact_groups(frame(texts), capacity=10).drop("stamp").collect()
    assert 0 < len(got) < len(want) and {tuple(r) for r in got} < set(want)
    monkeypatch.setattr(exact_dedup, "directory", lambda e, c: whole(e, c).withColumn("bucket", F.monotonically_increasing_id()))
    spread = exact_dedup.exact_groups(frame(texts), capacity=10).drop("stamp").collect()
    assert {tuple(r) for r in spread} == set(want)       # one bucket a cell: the same groups


def test_drop_copies_and_empty(frame):
    f = frame([(1, "same  text"), (2, "same text"), (3, "other"), (None, "other"), (2, "third")])
    left = exact_dedup.drop_copies(f)
    assert left.columns == f.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "same  text"), (2, "third"), (3, "other")]
    assert exact_dedup.exact_groups(frame([])).collect() == []


def test_drop_copies_leaves_one_row_a_group(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (1, "a b", "w"), (2, "a b", "z"), (None, "n  n", "p"), (None, "n n", "q"),
            (None, "n n", "q"), (3, None, "r"), (3, "", "s"), (4, "alone", "t"), (1, "other", "u")]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(tuple(r) in rows for r in left)
    assert sorted((r.doc_id or 0, " ".join((r.text or "").split())) for r in left) == [(0, "n n"), (1, "a b"), (1, "other"), (3, ""), (4, "alone")]
