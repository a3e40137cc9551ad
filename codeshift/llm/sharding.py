"""Sharding by jump consistent hashing.

The shard of a row is a pure function of its key and the number of shards; no
ring or table is kept.  Going from n to n + 1 shards moves a row either
nowhere or into the new shard.

Defined cases: a null text has size 8 and checksum 0; a null id hashes like
the bare seed and always lands in one shard; rows that repeat share a shard
and get slots of their own; an empty table gives an empty result.  Extra
columns are ignored by ``assign_shards`` and carried by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, materialize, shuffle_partitions, small_batches, whole_text

_STEP = np.uint64(2862933555777941757)  # fixed value of the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0..shards-1 of each 64-bit key: repeated jumps of a linear
    congruential generator until the next jump leaves the range."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = np.asarray(keys).astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * _STEP + np.uint64(1)
        span = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        to = np.floor((at[live] + 1) * (float(1 << 31) / span)).astype(np.int64)
        stays = to >= shards
        live, to = live[~stays], to[~stays]
        at[live] = to
    return at


def with_shards(df: DataFrame, key_col: str, counts: dict[str, int]) -> DataFrame:
    """``df`` and, per entry of ``counts``, the shard of the 64-bit ``key_col``
    among that many.  All counts are worked out in one pass of one worker."""
    out = T.StructType([*df.schema.fields, *(T.StructField(n, T.IntegerType()) for n in counts)])
    at = df.columns.index(key_col)

    def run(batches):
        for b in batches:
            keys = b.column(at).to_numpy().view(np.uint64)
            shards = [pa.array(jump_hash(keys, n).astype(np.int32)) for n in counts.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *shards], names=out.names)

    return df.mapInArrow(freed(run), out)


def assign_shards(df: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """id, size, text_crc32, shard, slot, grown_shard; one row per input row.

    Slots number the rows of a shard from 0 without gaps.  They are made of
    two levels, so no task holds a shard: rows are numbered within (shard,
    block), where a block is a hash range of the row, and the counts of the
    blocks (a small table) give each block its first slot.
    """
    spark = df.sparkSession
    text = F.encode(whole_text(text_col), "UTF-8")
    key = F.xxhash64(F.col(id_col))
    rows = df.select(F.col(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                     F.crc32(text).cast("long").alias("text_crc32"), key.alias("_key"))
    rows = materialize(with_shards(rows, "_key", {"shard": shards, "grown_shard": shards + 1}), "shards")
    blocks = max(8, shuffle_partitions(spark))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_block").orderBy("_key", F.col(id_col), "size", "text_crc32")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(first, ["shard", "_block"]).select(
        id_col, "size", "text_crc32", "shard",
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, id_col: str, shards: int, path: str) -> None:
    """All columns of ``df``, one folder ``shard=<n>`` per shard.  Each task
    writes its own file in each folder: no shard passes through one task."""
    small_batches(df.sparkSession)
    with_shards(df.withColumn("_key", F.xxhash64(F.col(id_col))), "_key", {"shard": shards}).drop("_key") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
