r"""Exact dedup with an extendible-hash index on shared files.

Texts are equal when identical after replacing each run of ``[\x20\x09-\x0D]``
by one space.  The index is built from DataFrame operations only:

1. every row's key (64-bit hash), digest and stamp are written, without its text;
2. a directory maps key prefixes (cells) to buckets.  It starts at one bucket and
   doubles wherever a bucket holds more than ``capacity`` distinct keys: a bucket
   is the shortest prefix whose load fits.  Its size is bounded by 2^MAX_DEPTH;
3. the directory sends every row to its bucket.  There rows of one key are grouped
   by their bytes, so different texts with an equal key become entries of one
   chain, numbered from 0; copies fold before the shuffle, however many there are;
4. owner tasks take ranges of (bucket, key) and write their entries, sorted, to
   the shared folder;
5. every row finds its entry through the directory: its cell names the bucket, and
   in the bucket key and digest name the entry of the chain.  The lookup moves
   ids, keys and digests, never texts; a large group is split by the join.

Both ways lead through the directory: a row whose cell it does not know has no
entry and is not found.

Defined cases: null text counts as empty; null ids never win over a known id
(a group with no known id has a null ``keep_id``, and its rows are marked kept);
rows that repeat the smallest id of their group are all marked kept.
``drop_copies`` leaves one row of each group, of these cases too; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, keep_one, materialize, row_stamp, whole_text

CAPACITY = 20_000
MAX_DEPTH = 14


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, depth: int | Column) -> Column:
    """The ``depth`` highest bits of a key."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    top = F.shiftrightunsigned(key, 64 - MAX_DEPTH)
    return F.floor(top / F.pow(F.lit(2), F.lit(MAX_DEPTH) - d)).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cell (MAX_DEPTH-bit prefix), depth, bucket: the directory of ``entries(key)``
    after all doublings.  At most 2^MAX_DEPTH rows whatever the input."""
    cells = entries.groupBy(_prefix(F.col("key"), MAX_DEPTH).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    up = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    up = up.withColumn("at", F.floor(F.col("cell") / F.pow(F.lit(2), F.lit(MAX_DEPTH) - F.col("depth"))).cast("long"))
    load = up.groupBy("depth", "at").agg(F.sum("n").alias("load"))
    fits = (F.col("load") <= capacity) | (F.col("depth") == MAX_DEPTH)
    # ``load`` has under 2^(MAX_DEPTH + 1) rows: a bounded broadcast.
    return (up.join(F.broadcast(load.where(fits)), ["depth", "at"])
            .groupBy("cell").agg(F.min(F.struct("depth", "at")).alias("leaf"))
            .select("cell", F.col("leaf.depth").alias("depth"),
                    (F.col("leaf.at") + F.pow(F.lit(2), F.col("leaf.depth")).cast("long")).alias("bucket")))


def row_keys(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    """id, stamp, key, digest, cell of every row; written."""
    norm = docs.select(F.col(id_col).alias("id"), row_stamp(text_col).alias("stamp"), normalised(text_col).alias("norm"))
    keyed = norm.select("id", "stamp", key(F.col("norm")).alias("key"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    return materialize(keyed.withColumn("cell", _prefix(F.col("key"), MAX_DEPTH)), "keys")


def build_index(docs: DataFrame, slots: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    """The index, read back from its files: bucket, key, chain, digest, keep_id,
    group_size.  ``slots``: the directory, which routes every row."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("key", key(F.col("norm")))
    routed = norm.withColumn("cell", _prefix(F.col("key"), MAX_DEPTH)).join(checked_broadcast(slots), "cell")
    entries = (routed.groupBy("bucket", "key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size"))
    entries = materialize(entries, "entries")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest")) - 1    # texts of one 64-bit key
    owned = entries.withColumn("chain", chain).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain")
    return materialize(owned, "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256, stamp; one row per document.
    ``key``: the 64-bit hash of a normalised text."""
    rows = row_keys(docs, id_col, text_col, key)
    slots = materialize(directory(rows.select("key").distinct(), capacity), "directory").select("cell", "bucket")
    index = build_index(docs, slots, id_col, text_col, key)
    return (rows.join(checked_broadcast(slots), "cell").join(index.drop("chain"), ["bucket", "key", "digest"])
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "stamp"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: one with the smallest id."""
    members = exact_groups(docs, id_col, text_col)
    return keep_one(docs, members.select(F.col(id_col).alias("id"), "stamp", F.col("text_sha256").alias("group"), "kept"),
                    id_col, text_col, "copies")
