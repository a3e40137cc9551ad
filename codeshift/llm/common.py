"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeshift.session import ensure_checkpoint_dir, materialize, scratch_path

__all__ = ["documents", "whole_text", "row_stamp", "checked_broadcast", "small_batches", "freed", "release_memory",
           "keep_one", "prune_by_bloom_filter", "unused", "worker_cache", "Scratch", "materialize", "scratch_path", "shuffle_partitions", "table"]

# A side is broadcast only when its (written, hence exactly known) size is below this.
BROADCAST_LIMIT = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(text: str | Column) -> Column:
    """The whole text; null counts as the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before them until ``df`` has no such
    column: further columns of a table never clash with those of an operator."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def row_stamp(text: str | Column) -> Column:
    """64-bit content stamp.  (id, stamp) names a row through re-scans: rows
    equal in both are copies with the same text and get the same result."""
    return F.xxhash64(whole_text(text))


def small_batches(spark: SparkSession, max_bytes: int = 2 << 20) -> None:
    """Cap Arrow batches by bytes, so a run of very long texts cannot fill a
    Python worker.  Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def release_memory() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dictionary that lives in a worker from task to task of the operators
    whose ``freed`` names it; a task of any other operator empties it."""
    return _CACHES.setdefault(name, {})


def empty_caches(but: str | None = None) -> None:
    for name, cache in _CACHES.items():
        if name != but:
            cache.clear()


def freed(run, cache: str | None = None):
    """``run`` (over Arrow batches) that hands memory it no longer uses back to
    the system: workers are kept for later tasks.  What other operators have
    left in the worker goes first, except in ``cache``."""
    def task(batches):
        empty_caches(cache)
        pa.set_memory_pool(pa.system_memory_pool())     # freed buffers can be handed back
        try:
            yield from run(batches)
        finally:
            release_memory()
    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written on the way of one operator, below the shared checkpoint
    folder.  A table is dropped once what was made of it is written itself, so an
    operator leaves only what its result still reads."""

    def __init__(self, spark: SparkSession):
        self._spark, self._written = spark, []

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = scratch_path(self._spark, name)
        df.write.options(**options).parquet(path)
        self._written.append((table := self._spark.read.parquet(path), path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        try:
            jvm, conf = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        except Exception:  # no JVM access (e.g. Spark Connect): the tables stay
            return
        for table, path in [w for w in self._written if any(w[0] is t for t in tables)]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            self._written = [w for w in self._written if w[0] is not table]


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint when the size the optimizer knows for it is
    at most ``limit`` bytes; otherwise ``df`` as it is (a shuffled join).  Use
    on tables just written, whose size is exact."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def prune_by_bloom_filter(spark: SparkSession) -> None:
    """Let Spark drop, by a Bloom filter made from the smaller side, the texts
    that a join will not need before it shuffles them, from any size on."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", str(1 << 40))


def keep_one(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with exactly one row per group of ``members(id, stamp, group,
    kept)``, which has one row per document.  Of the rows marked ``kept`` the
    least stamp stays; of rows equal in id and stamp, the one whose other
    columns come first as JSON.  Copies fold by aggregation before any shuffle,
    and texts of repeated rows only are folded, so no task holds a group."""
    keys = materialize(members.groupBy("id", "stamp", "group", "kept").agg(F.count(F.lit(1)).alias("n")), f"{name}-keys")
    kept = keys.where("kept")
    several = materialize(kept.groupBy("group").agg(F.min("stamp").alias("first"), F.count(F.lit(1)).alias("keys"))
                          .where("keys > 1").select("group", "first"), f"{name}-first")
    i, s, none, row = unused(docs, "id", "stamp", "none", "row")
    named = lambda df: df.select(F.col("id").alias(i), F.col("stamp").alias(s))
    gone = named(keys.where(~F.col("kept"))).unionByName(
        named(kept.join(checked_broadcast(several), "group").where(F.col("stamp") != F.col("first"))))
    # The dropped keys are written first: their size decides how they are joined.
    gone, again = materialize(gone, name), materialize(named(kept.where("n > 1")), f"{name}-repeated")
    same = F.col(id_col).eqNullSafe(F.col(i)) & (row_stamp(text_col) == F.col(s))
    left = docs.join(checked_broadcast(gone), same, "left_anti")
    if again.isEmpty():
        return left
    others = F.to_json(F.struct(F.lit(0).alias(none), *[c for c in docs.columns if c not in (id_col, text_col)]))
    folded = (left.join(checked_broadcast(again), same, "left_semi")
              .groupBy(F.col(id_col).alias(i), row_stamp(text_col).alias(s))
              .agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNull(), others)).alias(row)).select(f"{row}.*"))
    return left.join(checked_broadcast(again), same, "left_anti").unionByName(folded)
