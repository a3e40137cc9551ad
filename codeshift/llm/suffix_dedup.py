r"""Dedup of repeated strings by bucket refinement over sampled suffixes.

Every byte covered by a ``length``-byte string that also starts anywhere else
is removed; strings are judged on the input and never cross documents.

A suffix array groups positions by their first ``length`` bytes.  Here it is
built only as far as that: positions are put into buckets by a q-gram, and
buckets are refined, round by round, by the buckets that strings at further
offsets fall into, each round halving the offsets in question and starting from
the buckets of the round before.  Every round is a written table, and what is
alone in its bucket drops out of it.

1. *Initial buckets* (q = length / 2).  A window of ``length`` bytes is
   represented by one of its q-grams, the leftmost with the least rolling hash.
   Equal windows pick the same q-gram at the same place, so only these anchors,
   about one in q / 2 positions, are bucketed; each owns a run of consecutive
   windows.  A window is known by how many bytes of it lie before the q-gram.
   Anchors of one bucket whose windows are equal throughout form a class, which
   settles its members and sends one of them on; a bucket of one class is done.
2. *Refinement.*  A round has, for each bucket, a range of offsets a to b.  All its
   windows hold the last a bytes before the q-gram and the first
   length - q - b bytes after it.  The old bucket stands for what the wider range
   before had of these; the string at the offsets that are new has an identifier
   of its own (its digest), and the two name the new bucket.  Members equal in all bytes that their windows in the range hold form a
   class again.  What is left, one of each class where a bucket has several, goes
   on with both halves of the range.  A range of one offset is a single window, so
   there are log2(q) rounds, whatever the input.

Two strings that agree in fewer bytes than a window needs share a bucket in at
most one range a round, and equal runs of windows fold into classes, so a round
has about as many rows as the one before at most.  Nothing is compared pairwise;
a bucket is never gathered, only counted, and copies fold before the shuffle.
Strings are named by 128-bit digests, contexts of the first round by two 64-bit
hashes.

With ``keep_first``, windows stay where they occur first (by id, known ids first,
then text digest and place) and only later occurrences are removed.

Defined cases: null text counts as empty; documents shorter than ``length``
keep every byte; rows that repeat (same id, same text) are documents of their
own, so each loses what they share (with ``keep_first`` they are one, and keep what
occurs there first); null ids are kept; an empty table gives an empty result;
further columns are ignored by the report and carried by ``remove_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, checked_broadcast, freed, materialize, prune_by_bloom_filter, row_stamp, small_batches, unused, whole_text

LENGTH = 400
_EMIT = 4 << 20                  # bytes of contexts sent at once
_PLACE = 20                      # low bits of a sort key that hold the place
_SEGMENT = 1 << 17               # windows handled at once
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Rolling hashes of all q-grams of a byte string, modulo 2^64."""

    def __init__(self, length: int):
        self.length, self.q = length, length // 2
        self.width = length - self.q + 1           # q-grams in a window
        n = _SEGMENT + length + 1
        self.up = _powers(int(_BASE), n)
        self.down = _powers(pow(int(_BASE), -1, 1 << 64), n)

    def grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(data * self.up[:n], out=total[1:])
        h = (total[self.q:] - total[:n - self.q + 1]) * self.down[:n - self.q + 1]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        return h

    def anchors(self, raw: bytes):
        """For runs of windows with one anchor: first window, last window,
        anchor place, hash of the anchor's q-gram."""
        windows = len(raw) - self.length + 1
        for s in range(0, windows, _SEGMENT):
            e = min(windows, s + _SEGMENT)
            h = self.grams(np.frombuffer(raw, np.uint8, e - s + self.length - 1, s).astype(np.uint64))
            low = np.uint64((1 << _PLACE) - 1)
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            place = (_sliding_min(key, self.width) & low).astype(np.int64)
            edge = np.flatnonzero(place[1:] != place[:-1]) + 1
            first = np.concatenate(([0], edge))
            last = np.concatenate((edge, [len(place)])) - 1
            p = place[first]
            yield first + s, last + s, p + s, h[p]


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_SPANS = "array<struct<lo:int,hi:int>>"


def _anchors(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """id, stamp, gram, context, lo, hi, place: one row per class of anchors in
    a document, owning the windows that start in lo..hi-length.  Rows with a
    null gram are spans to remove because they repeat inside the document."""
    out = T.StructType([docs.schema[0], docs.schema[1], *(T.StructField(n, T.LongType()) for n in ("gram", "context")),
                        *(T.StructField(n, T.IntegerType()) for n in ("lo", "hi", "place"))])

    def run(batches):
        hasher = _Hasher(length)
        for b in batches:
            at, gram, context, lo, hi, place = [], [], [], [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                raw = text.encode("utf-8")
                if len(raw) < length:
                    continue
                view, seen, twice = memoryview(raw), {}, []
                for first, last, anchor, h in hasher.anchors(raw):
                    for i, j, p, g in zip(first.tolist(), last.tolist(), anchor.tolist(), h.view(np.int64).tolist()):
                        k = (g, _long(xxhash.xxh3_64_intdigest(view[i:j + length], p - i)))
                        if (old := seen.setdefault(k, (i, j + length, p)))[0] != i:
                            twice += [(i, j + length)] if keep_first else [old[:2], (i, j + length)]
                for (g, c), (i, j, p) in seen.items():
                    at.append(row), gram.append(g), context.append(c), lo.append(i), hi.append(j), place.append(p)
                for i, j in _merge(twice):
                    at.append(row), gram.append(None), context.append(None), lo.append(i), hi.append(j), place.append(None)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(gram, pa.int64()), pa.array(context, pa.int64()),
                 *(pa.array(x, pa.int32()) for x in (lo, hi, place))], names=out.names)

    return docs.mapInArrow(freed(run), out)


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """id, stamp, lo, hi, place, gram, core, left, right: for each span listed,
    a hash of its anchor's q-gram and the bytes on either side of it."""
    q = length // 2
    out = T.StructType([texts.schema[0], texts.schema[1], *(T.StructField(n, T.IntegerType()) for n in ("lo", "hi", "place")),
                        T.StructField("gram", T.LongType()), T.StructField("core", T.LongType()),
                        T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())])
    kinds = [f.type for f in to_arrow_schema(out)][2:]

    def run(batches):
        for b in batches:
            at, got, size = [], [], 0

            def flush():
                row = pa.array(at, pa.int64())
                cols = list(zip(*got)) or [()] * len(kinds)
                batch = pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row),
                                                    *(pa.array(c, k) for c, k in zip(cols, kinds))], names=out.names)
                at.clear(), got.clear()
                return batch

            texts, lists = b.column(2), b.column(3)
            for row in range(b.num_rows):                 # one text at a time
                raw = texts[row].as_py().encode("utf-8")
                for s in lists[row].as_py():
                    lo, hi, p = s["lo"], s["hi"], s["place"]
                    at.append(row)
                    got.append((lo, hi, p, s["gram"], _long(xxhash.xxh3_64_intdigest(raw[p:p + q])), raw[lo:p], raw[p + q:hi]))
                    size += hi - lo
                    if size >= _EMIT:
                        yield flush()
                        size = 0
            yield flush()

    return texts.mapInArrow(freed(run), out)


def _texts_of(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """id, stamp, text, spans of the documents in ``listed(id, stamp, spans)``.
    Always a shuffled join: texts move once, those not listed stay."""
    r, k = rows.alias("r"), listed.where(F.size("spans") > 0).hint("merge").alias("k")
    return r.join(k, (F.xxhash64("r.text") == F.col("k.stamp")) & F.col("r.id").eqNullSafe(F.col("k.id"))) \
        .select("r.id", "r.stamp", "r.text", "k.spans")


_KEYS = ("id", "stamp")
_WHO = ("id", "stamp", "lo", "hi", "place")


def _who(prefix: str = "") -> Column:
    """A place, ordered by id (known ids first), text digest and byte."""
    c = {n: F.col(prefix + n) for n in _WHO}
    return F.struct(c["id"].isNull().alias("none"), *(c[n].alias(n) for n in _WHO))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _refine(state: DataFrame, length: int, keep_first: bool, made: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One round.  ``state``: places with a bucket, a range of offsets a to b, the
    range a0 to b0 of the round before and their contexts.  Gives the spans that
    settle, the state of the next round, and the tables that both are read from."""
    span = length - length // 2
    last = lambda n: F.substr("left", F.octet_length("left") - n + 1, n)
    new_left = F.substr("left", F.octet_length("left") - F.col("a") + 1, F.col("a") - F.col("a0"))
    new_right = F.substr("right", F.lit(span + 1) - F.col("b0"), F.col("b0") - F.col("b"))
    first = lambda n: F.substr("right", F.lit(1), n)                      # noqa: E731
    a, b = F.col("a"), F.col("b")
    low = F.greatest(a, F.col("place") - F.col("hi") + length)            # offsets in the range that the place owns
    high = F.least(b, F.col("place") - F.col("lo"))
    keyed = state.withColumn("low", low).withColumn("high", high)
    own = F.encode(F.concat_ws(",", "low", "high"), "utf-8")
    further = _digest(F.encode(F.concat_ws(",", "a", "b"), "utf-8"), new_left, new_right)
    keyed = keyed.withColumn("to", _digest(F.unhex("bucket"), further)) \
        .withColumn("class", _digest(own, last(F.col("high")), first(F.lit(span) - F.col("low"))))
    one = F.min(F.struct(_who().alias("who"), "left", "right")).alias("one")
    classes = made.table(keyed.groupBy("to", "class", "a", "b").agg(F.count(F.lit(1)).alias("n"), one), "classes")
    many = classes.where("n > 1").select("to", "class", F.col("one.who").alias("first"))
    settled = keyed.join(many.hint("merge"), ["to", "class"])
    if keep_first:
        settled = settled.where(~_who().eqNullSafe(F.col("first")))
    settled = settled.select(*_KEYS, (F.col("place") - F.col("high")).alias("lo"),
                             (F.col("place") - F.col("low") + length).alias("hi"))
    several = made.table(classes.groupBy("to").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("to"), "several")
    half = F.floor((a + b) / 2).cast("int")
    halves = F.array(F.struct(a.alias("a"), half.alias("b")), F.struct((half + 1).alias("a"), b.alias("b")))
    on = (classes.join(checked_broadcast(several), "to").where(a < b)
          .select(*(F.col(f"one.who.{n}").alias(n) for n in _WHO), F.hex("to").alias("bucket"), F.col("one.left").alias("left"),
                  F.col("one.right").alias("right"), a.alias("a0"), b.alias("b0"), F.explode(halves).alias("r"))
          .withColumns({"a": F.col("r.a"), "b": F.col("r.b")}).drop("r").where(low <= high))
    return settled, on, [classes, several]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   keep_first: bool = False) -> DataFrame:
    """id, stamp, spans: byte spans to remove, for each document that has any
    (rows that repeat have one entry).  Spans may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    prune_by_bloom_filter(spark)
    made = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), row_stamp(text_col).alias("stamp"), whole_text(text_col).alias("text"))
    anchors = made.table(_anchors(rows, length, keep_first), "anchors")
    found = [made.table(anchors.where(F.col("gram").isNull()).select(*_KEYS, "lo", "hi"), "inside")]

    # Initial buckets with company, and their classes.
    named = anchors.where(F.col("gram").isNotNull())
    shared = named.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    company = made.table(named.join(shared.hint("merge"), "gram"), "company")
    made.drop(anchors)
    classes = made.table(company.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(_who()).alias("one")), "classes")
    members = company.join(classes.where("n > 1").select("gram", "context", F.col("one").alias("first")).hint("merge"), ["gram", "context"])
    if keep_first:
        members = members.where(~_who().eqNullSafe(F.col("first")))
    found.append(made.table(members.select(*_KEYS, "lo", "hi"), "members"))
    made.drop(company)

    # One of each class, with its contexts, where a bucket has several.
    several = made.table(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram"), "several")
    one = classes.join(checked_broadcast(several), "gram").select("gram", "one.*")
    listed = made.table(one.groupBy(*_KEYS).agg(F.collect_list(F.struct("gram", "lo", "hi", "place")).alias("spans")), "listed")
    made.drop(classes, several)
    bucket = F.concat(F.lpad(F.hex("gram"), 16, "0"), F.lpad(F.hex("core"), 16, "0")).alias("bucket")
    state = made.table(_contexts(_texts_of(rows, listed), length).select(
        *_WHO, bucket, "left", "right", *(F.lit(0).alias(n) for n in ("a0", "a")),
        *(F.lit(length - length // 2).alias(n) for n in ("b0", "b"))), "buckets")
    made.drop(listed)
    while not state.isEmpty():
        settled, on, used = _refine(state, length, keep_first, made)
        found.append(made.table(settled, "settled"))
        on = made.table(on, "buckets")
        made.drop(state, *used)
        state = on
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = materialize(spans.groupBy(*_KEYS).agg(F.collect_set(F.struct("lo", "hi")).cast(_SPANS).alias("spans")), "spans")
    made.drop(state, *found)
    return spans


def cut(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left",
        in_place: bool = False) -> DataFrame:
    """The columns of ``docs`` and _kept (the bytes that stay), _removed,
    _runs; ``how="inner"`` gives only documents that lose something.  With
    ``in_place``, the columns of ``docs`` alone, the text being what is left."""
    i, s, list_ = unused(docs, "id", "stamp", "spans")
    spans = spans.where(F.size("spans") > 0).select(F.col("id").alias(i), F.col("stamp").alias(s), F.col("spans").alias(list_))
    same = (row_stamp(docs[text_col]) == F.col(s)) & docs[id_col].eqNullSafe(F.col(i))
    joined = docs.join(spans.hint("merge"), same, how).drop(i, s)
    out = docs.schema if in_place else T.StructType([
        *docs.schema.fields, T.StructField("_kept", T.BinaryType()), T.StructField("_removed", T.LongType()),
        T.StructField("_runs", T.LongType())])
    text_at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            kept, gone, runs = [], [], []
            for text, listed in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                raw = (text or "").encode("utf-8")
                merged = _merge([(s["lo"], s["hi"]) for s in listed or ()])
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept.append(b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                gone.append(len(raw) - len(kept[-1])), runs.append(len(merged))
            if in_place:
                columns = b.columns[:-1]
                columns[text_at] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=out.names)
                continue
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())],
                names=out.names)

    return joined.mapInArrow(freed(run), out)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   keep_first: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256; one row per document.
    Documents that lose nothing are settled where they are read."""
    spans = repeated_spans(docs, id_col, text_col, length, keep_first)
    stamp = row_stamp(text_col).alias("_stamp")
    whole = docs.select(F.col(id_col).alias("id"), stamp, F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"),
                        F.sha2(whole_text(text_col), 256).alias("sha"))
    less = cut(docs.select(id_col, text_col), spans, id_col, text_col, "inner") \
        .select(F.col(id_col).alias("_id"), stamp, "_removed", "_runs", F.sha2("_kept", 256).alias("_sha")).distinct()
    less = less.withColumnRenamed("_stamp", "_stamp2")
    both = whole.join(less.hint("merge"), (F.col("_stamp") == F.col("_stamp2")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    zero = F.lit(0).cast("long")
    return both.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("_removed", zero).alias("n_removed"),
                       F.coalesce("_runs", zero).alias("n_spans"), F.coalesce("_sha", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   keep_first: bool = False) -> DataFrame:
    """``docs`` with the text that is left; a character that a removal cuts in
    two goes with it.  Documents stay, even when nothing is left of them."""
    return cut(docs, repeated_spans(docs, id_col, text_col, length, keep_first), id_col, text_col, in_place=True)
