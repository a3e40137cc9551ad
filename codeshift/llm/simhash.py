r"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: A-Z are lower-cased, words are ``[^\x20\x09-\x0D]+``, shingles are
``shingle`` consecutive words joined by a space, repeats included (fewer words:
the whole sequence; none: fingerprint zero).  A bit is 1 when it is set in over
half of the shingles' 64-bit hashes.

Linking: fingerprints link at ``radius`` or fewer differing bits.  For radius r
each bit position gets a non-zero label of r + 1 bits; table v keeps the
positions whose label has odd parity with v.  The labels of r differing
positions span at most r dimensions, so some v is orthogonal to all of them
and that table's mask leaves both fingerprints equal: every pair within the
radius meets in one of the 2^(r+1) - 1 tables, with certainty.

Only distinct fingerprints enter the tables, so copies cost one entry.  In a
bucket of at most ``BUCKET`` fingerprints the bit distance is checked within
the row and only true links leave it.  Larger buckets are not compared at all:
each of their fingerprints lists the values within r/2 bits of it, and two
fingerprints are within r bits exactly when they share such a value.  This
costs a fixed number of rows per fingerprint and loses no link.

Defined cases: null text counts as empty; rows with null ids are fingerprinted
and belong to the component of their fingerprint; ids that repeat are separate
rows; ``drop_near_copies`` leaves one row of each component, of repeated rows
and null ids too; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, freed, keep_one, materialize, row_stamp, small_batches, whole_text
from .graph import components

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
BUCKET = 48
_BLOCK = 1 << 15  # shingles counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and only ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at:at + _BLOCK + shingle - 1]
        grams = [b" ".join(words)] if len(words) < shingle else \
            map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        digests = b"".join([xxhash.xxh64_digest(g, seed) for g in grams])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, stamp, fp (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), row_stamp(text_col).alias("stamp"), whole_text(text_col).alias("text"))
    out = T.StructType([*rows.drop("text").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = pa.array([_signed(fingerprint(t, shingle, seed)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["id", "stamp", "fp"])

    return rows.mapInArrow(freed(run), out)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per table; labels are dealt to the positions in turn."""
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % tables) & v).count("1") % 2)
            for v in range(1, tables + 1)]


def _ball(radius: int) -> list[int]:
    """All flips of at most ``radius`` bits."""
    return [sum(1 << i for i in flips) for k in range(radius + 1) for flips in combinations(range(BITS), k)]


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between the distinct fingerprints ``fps(fp)`` whose closure
    is the closure of all pairs within ``radius`` bits (an even number)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    keyed = fps.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius)])).alias("table", "key"))
    shared = materialize(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = keyed.join(checked_broadcast(shared), ["table", "key"])
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    pairs = F.flatten(F.transform("all", lambda x: F.transform(
        F.filter("all", lambda y: (y < x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = (met.where(F.col("n") <= bucket).groupBy("table", "key").agg(F.collect_list("fp").alias("all"))
           .select(F.explode(pairs).alias("p")).select("p.a", "p.b"))
    flips = F.array(*[F.lit(_signed(m)) for m in _ball(radius // 2)])
    # A ball holds at most one fingerprint per flip: its group is bounded.
    centres = (met.where(F.col("n") > bucket).select("fp").distinct()
               .select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
               .groupBy("centre").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1))
    many = centres.select(F.explode("all").alias("a"), "b").where("a != b")
    return few.unionByName(many).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """id, stamp, fp, component_id, root: one row per document; ``component_id``
    is the smallest id reachable over links, the document's own included, and
    ``root`` the smallest fingerprint."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius, bucket))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = materialize(placed.join(smallest, "root").select("fp", "component_id", "root"), "components")
    return rows.join(checked_broadcast(member), "fp").select(F.col("id").alias(id_col), "stamp", "fp", "component_id", "root")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: one with the smallest id."""
    near = near_groups(docs, id_col, text_col)
    return keep_one(docs, near.select(F.col(id_col).alias("id"), "stamp", F.col("root").alias("group"),
                                      F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept")),
                    id_col, text_col, "near-copies")
