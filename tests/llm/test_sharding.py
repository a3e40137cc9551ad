import zlib
from collections import Counter

import numpy as np

from codeshift.llm import sharding


def jump(key, shards):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 20000, dtype=np.uint64)
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b].tolist()) == {24}
    assert abs((a != b).mean() - 1 / 25) < 0.01
    assert Counter(a.tolist()).most_common()[-1][1] > 20000 / 24 * 0.8


def test_rows_slots_and_nulls(frame, texts):
    rows = texts + [(1, texts[1][1]), (None, "x"), (None, None), (7, None), (8, "é")]
    got = sharding.assign_shards(frame(rows), "doc_id", "text", 24).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def test_empty_and_written(frame, spark, tmpdir_spark):
    assert sharding.assign_shards(frame([]), "doc_id", "text", 24).collect() == []
    rows = [(i, f"t{i}") for i in range(50)]
    sharding.write_shards(frame(rows), "doc_id", 4, tmpdir_spark + "/s")
    back = spark.read.parquet(tmpdir_spark + "/s")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert {r.shard for r in back.select("shard").collect()} <= {0, 1, 2, 3}
