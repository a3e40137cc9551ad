"""Order-dependent helpers that stay distributed when one group is huge.

Spark rows carry no order, so every "first" or "in order of appearance" rule
works on an explicit ordinal.  The helpers here avoid the two patterns that
put a whole group into one task: a window partitioned by a possibly hot key
over all of its rows, and a window with no partition key at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_totals(df: DataFrame, part_cols: list[str], order_col: str, values: dict[str, str],
                   chunk: int = 4096, inclusive: bool = False) -> DataFrame:
    """Add, for each ``value_col -> out_col`` of ``values``, the sum of
    ``value_col`` over earlier rows of the same group (by ``order_col``).

    Two levels, so that no task sees more than ``chunk`` consecutive order
    values of one group: rows are cut into chunks of ``order_col div chunk``;
    chunk totals (one row per chunk, partial aggregation before the shuffle)
    get an exclusive prefix sum per group; rows get a prefix sum inside their
    chunk.  ``order_col`` must be an integer column (a message index).  Pass
    a narrow frame: it is read twice (chunk totals and row sums).
    """
    keyed = df.withColumn("_chunk", F.floor(F.col(order_col) / F.lit(chunk)))
    totals = keyed.groupBy(*part_cols, "_chunk").agg(
        *[F.sum(v).alias(f"_t_{o}") for v, o in values.items()])
    w_chunks = (Window.partitionBy(*part_cols).orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*part_cols, "_chunk", *[
        F.coalesce(F.sum(f"_t_{o}").over(w_chunks), F.lit(0)).alias(f"_off_{o}") for o in values.values()])
    hi = 0 if inclusive else -1
    w_rows = (Window.partitionBy(*part_cols, "_chunk").orderBy(order_col)
              .rowsBetween(Window.unboundedPreceding, hi))
    inner = keyed.select("*", *[F.coalesce(F.sum(v).over(w_rows), F.lit(0)).alias(f"_in_{o}")
                                for v, o in values.items()])
    j = inner.join(offsets, [*part_cols, "_chunk"], "left")
    return j.select(*df.columns, *[(F.col(f"_off_{o}") + F.col(f"_in_{o}")).cast("long").alias(o)
                                   for o in values.values()])


def running_total(df: DataFrame, part_cols: list[str], order_col: str, value_col: str,
                  out_col: str, chunk: int = 4096, inclusive: bool = False) -> DataFrame:
    """One running total; see ``running_totals``."""
    return running_totals(df, part_cols, order_col, {value_col: out_col}, chunk, inclusive)


def first_appearance_index(df: DataFrame, key: str, order_cols: list[str], out_col: str) -> DataFrame:
    """Dictionary ``(key, out_col)``: 0-based rank (long) of each distinct
    ``key`` by the smallest ``order_cols`` tuple it appears with.  The distinct
    keys are found with a partial aggregate and ranked by ``global_rank``,
    however many there are; the result is a written table."""
    first = df.groupBy(key).agg(F.min(F.struct(*order_cols)).alias("_first"))
    return materialize(global_rank(first, ["_first", key], out_col).select(key, out_col), "dictionary")


def _ranged(df: DataFrame, order_cols: list[str], partitions: int | None) -> DataFrame:
    """``df`` in ``order_cols`` order over range partitions, written, with
    ``_place``: the partition (high bits) and the row in it (33 low bits)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                       .withColumn("_place", F.monotonically_increasing_id()), "ranged")


_PART, _ROW = "shiftright(_place, 33)", "(_place & 8589934591L)"


def global_rank(df: DataFrame, order_cols: list[str], out_col: str, partitions: int | None = None) -> DataFrame:
    """0-based dense position (long) of each row in ``order_cols`` order.

    Rows are range-partitioned, sorted and written with their place (so the
    numbers are stable); a row's rank is its place plus the rows of the
    partitions before.  The only window is over one row per partition.
    """
    ranged = _ranged(df, order_cols, partitions).withColumn("_part", F.expr(_PART))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_part")          # one row per partition
            .withColumn(out_col, (F.col("_off") + F.expr(_ROW)).cast("long")).drop("_part", "_place", "_off"))


def quantiles(df: DataFrame, cols: list[str], fractions: list[float]) -> DataFrame:
    """One row with an array column ``_q<i>`` per column: its exact quantiles
    with linear interpolation.

    Values are counted per (column, value) with a partial aggregate; the counts
    are range-partitioned by column and value.  Partition totals (a small table)
    say which partition holds a wanted rank, and only rows of those partitions
    get running sums.  No task holds a column's values.
    """
    entries = ", ".join(f"named_struct('g', {i}, 'v', CAST(`{c}` AS DOUBLE))" for i, c in enumerate(cols))
    counts = (df.selectExpr(f"inline(array({entries}))").where("v IS NOT NULL")
              .groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")))
    ranged = _ranged(counts, ["g", "v"], None).withColumn("_part", F.expr(_PART))
    # One row per (column, partition): at most columns + partitions of them.
    parts = ranged.groupBy("g", "_part").agg(F.sum("n").alias("size"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "_part", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"),
                         F.sum("size").over(Window.partitionBy("g")).alias("total"))
    at = [f"named_struct('k', {k}, 'at', (total - 1) * {f}D)" for k, f in enumerate(fractions)]
    wanted = (parts.selectExpr("g", "_part", "before", "size", f"inline(array({', '.join(at)}))")
              .selectExpr("*", "inline(array(named_struct('rank', floor(at), 'share', 1 - (at - floor(at))), "
                               "named_struct('rank', ceil(at), 'share', at - floor(at))))")
              .where("share > 0 AND rank >= before AND rank < before + size").drop("size", "at"))
    wanted = F.broadcast(wanted)                                 # at most 2 * columns * fractions rows
    near = ranged.join(wanted.select("g", "_part").distinct(), ["g", "_part"], "left_semi")
    upto = Window.partitionBy("g", "_part").orderBy("v")
    summed = near.select("g", "_part", "v", "n", F.sum("n").over(upto).alias("upto"))
    hit = (summed.join(wanted, ["g", "_part"])
           .where("before + upto - n <= rank AND rank < before + upto")
           .groupBy("g", "k").agg(F.sum(F.col("v") * F.col("share")).alias("q")))
    pick = "max(CASE WHEN g = {i} AND k = {k} THEN q END)"
    return hit.selectExpr(*["array(" + ", ".join(pick.format(i=i, k=k) for k in range(len(fractions))) + f") AS _q{i}"
                            for i in range(len(cols))])
