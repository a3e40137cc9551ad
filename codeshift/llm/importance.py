r"""Importance resampling towards a target, by bit-sliced aggregation.

Features are runs of 1 to ``grams`` consecutive words of a lower-cased text
(``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``), hashed to ``buckets`` buckets.  The gain of a
bucket is the floored, scaled log ratio of its smoothed share among the target's
features and among the documents'.  A document's weight is the floored mean of
its features' gains; documents are drawn without replacement by weight plus a
Gumbel number made from their id.

Weights come from bits alone.  The gains are cut into two's complement bit
planes, vectors of one bit per bucket, the last of which counts negative.  A
document's bucket counts are cut into planes in the same way.  The sum of all
gains is then exact:

    sum over i, j of  +-2^(i + j) * popcount(count plane i AND gain plane j)

Planes of a document span only 64-bit words in which it has a feature; they are
made, joined with the gain planes and dropped in blocks, so memory does not
grow with the table or a text.

Steps: (1) bucket counts of the documents and of the target, folded per task, then
by Spark; (2) the gains, one per bucket, in the driver; (3) weights and scores, a
map over the documents, written; (4) the cut: scores are whole numbers within a
bound set by 64-bit counts, so the counts per score are a small table that gives
the lowest score drawn; (5) the rows from there on are range-partitioned by score
and id, and their rank is their place plus the rows of the partitions before.

Defined cases: null text counts as empty (no features, weight 0); a null id
hashes like an empty id and ranks behind known ids of its score; rows that
repeat are drawn as rows of their own; without a target, or without documents,
gains follow the same formula; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, freed, materialize, shuffle_partitions, small_batches, whole_text

BUCKETS, GRAMS, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
SCALE = 1000
_TERMS = 500_000       # words known at once
_BLOCK = 1 << 18       # features handled at once
_MASK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased: bytes of other characters are part of words."""
    return (text or "").encode("utf-8").translate(_MASK).split()


class _Buckets(dict):
    """Feature -> bucket, made when first met and forgotten when there are many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _TERMS:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def _features(words: list[bytes], grams: int):
    """Lists of features, a bounded number each: all runs of 1 to ``grams`` words."""
    for size in range(1, grams + 1):
        for s in range(0, len(words) - size + 1, _BLOCK):
            part = words[s:s + _BLOCK + size - 1]
            yield part if size == 1 else list(map(b" ".join, zip(*(part[k:] for k in range(size)))))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """bucket, n: features of all texts per bucket.  Folded per task before the shuffle."""
    small_batches(docs.sparkSession)
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        total, at = np.zeros(buckets, np.int64), _Buckets(buckets)
        for b in batches:
            for text in b.column(0).to_pylist():
                for part in _features(words_of(text), grams):
                    total += np.bincount(np.fromiter(map(at.__getitem__, part), np.int64, len(part)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=out.names)

    parts = docs.select(whole_text(text_col).alias("text")).mapInArrow(freed(run), out)
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """The gain of every bucket.  At most ``buckets`` counts reach the driver."""
    def counts(df):
        n = [0] * buckets
        for r in bucket_counts(df, text_col, buckets, grams).collect():
            n[r["bucket"]] = r["n"]
        return n
    s, t = counts(docs), counts(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(SCALE * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[-1] // 64) * 64
    wide = np.zeros((*bits.shape[:-1], width), bool)
    wide[..., :bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement bit planes of the gains, and what a bit of each counts."""
    low, high = int(gain.min(initial=0)), int(gain.max(initial=0))
    bits = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    planes = _packed(np.stack([(gain >> j) & 1 == 1 for j in range(bits + 1)]))
    counts = [1 << j for j in range(bits)] + [-(1 << bits)]
    return planes, np.array(counts, np.int64)


def weight_sums(rows: np.ndarray, at: np.ndarray, n: int, planes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the gains of each of ``n`` documents.  ``at[k]`` is the bucket of
    a feature of document ``rows[k]``."""
    total = np.zeros(n, np.int64)
    if not len(rows):
        return total
    words = planes.shape[1]
    cell, times = np.unique(rows * (words * 64) + at, return_counts=True)
    word, bit = cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64)
    place, first = np.unique(word, return_index=True)            # 64-bit words in use, by document
    doc, column = place // words, place % words
    for i in range(int(times.max()).bit_length()):
        plane = np.bitwise_or.reduceat(np.where(times >> i & 1 == 1, bit, np.uint64(0)), first)
        held = np.flatnonzero(plane)
        sums = np.zeros(len(held), np.int64)
        for j, count in enumerate(counts.tolist()):
            sums += count * np.bitwise_count(plane[held] & planes[j, column[held]]).astype(np.int64)
        np.add.at(total, doc[held], sums << i)
    return total


def gumbel(key: str) -> int:
    """Floored, scaled Gumbel number of a key."""
    h = int(hashlib.sha256(key.encode("utf-8")).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS,
           seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score; one row per document."""
    small_batches(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), whole_text(text_col).alias("text"))
    out = T.StructType([rows.schema["id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score"))])
    planes, counts = gain_planes(gain)
    buckets = len(gain)

    def run(batches):
        known = _Buckets(buckets)
        for b in batches:
            texts = b.column(2).to_pylist()
            n_words, n_features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            total, held = np.zeros(len(texts), np.int64), []
            rows, size = [], 0

            def flush():
                at = np.concatenate(held) if held else np.zeros(0, np.int64)
                which = np.repeat(np.array([r for r, _ in rows], np.int64), [n for _, n in rows])
                total[:] += weight_sums(which, at, len(texts), planes, counts)
                held.clear(), rows.clear()

            for row, text in enumerate(texts):
                words = words_of(text)
                n_words[row] = len(words)
                for part in _features(words, grams):
                    held.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
                    rows.append((row, len(part)))
                    n_features[row] += len(part)
                    size += len(part)
                    if size >= _BLOCK:
                        flush()
                        size = 0
            flush()
            weight = total // np.maximum(n_features, 1)
            score = weight + np.array([gumbel(k) for k in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight, score))], names=out.names)

    return rows.mapInArrow(freed(run), out)


def lowest_drawn(table: DataFrame, least_words: int, percent: int) -> tuple[int, int | None]:
    """How many documents are drawn, and the lowest score among them.  A score
    lies within a bound of the logarithms of 64-bit counts, so there are at most
    about 130,000 of them; their counts are what reaches the driver."""
    counts = table.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    draw = percent * sum(r["n"] for r in counts) // 100
    left = draw
    for score, n in sorted(((r["score"], r["n"]) for r in counts), reverse=True):
        if left <= n:
            return draw, score if left else None
        left -= n
    return draw, None


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
             grams: int = GRAMS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_features, weight, score, rank; one row per document.  ``rank`` is
    1, 2, 3... for the drawn ones (``percent`` of those with at least
    ``least_words`` words, highest scores first, ties to the smaller id)."""
    spark = docs.sparkSession
    table = materialize(scored(docs, gains(target, docs, text_col, buckets, grams), id_col, text_col, grams, seed), "scored")
    draw, low = lowest_drawn(table, least_words, percent)
    none = F.lit(None).cast("long").alias("rank")
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(low)) if low is not None else F.lit(False)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = table.where(~drawn).select(*columns, none)
    if low is None:
        return rest
    # The row number keeps rows equal in score and id apart, so they spread over ranges too.
    order = [F.col("score").desc(), F.col("id").isNull(), F.col("id"), F.col("row")]
    ranged = (table.where(drawn).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
              .withColumn("place", F.monotonically_increasing_id()).drop("row"))
    ranged = materialize(ranged, "drawn")
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: a window over so few rows is no bottleneck.
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = ranged.withColumn("part", part).join(checked_broadcast(materialize(before, "places")), "part") \
        .withColumn("rank", (F.col("before") + nth + 1).cast("long"))
    return rest.unionByName(placed.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")))
