"""H1/H2: column normalisation over all numeric columns.

Statistics come from one aggregate: with no key it is a single row attached
by a broadcast cross join (one row by construction); with a key it is one row
per key, written and joined back: broadcast where its bytes allow, so the wide
rows stay where they are.  No window over the whole table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, materialize
from .columns import ID_COLUMNS, numeric_columns


def _attach(df: DataFrame, stats: DataFrame, partition_by) -> DataFrame:
    if partition_by:
        return df.join(checked_broadcast(materialize(stats, "key-stats")), list(partition_by), "left")
    return df.crossJoin(F.broadcast(stats))


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _normalize(df: DataFrame, method: str, exclude, partition_by, truncate: bool,
               parity: bool, columns=None) -> DataFrame:
    # Expressions are SQL strings: one JVM call per column instead of one per
    # function node, which dominates planning time on wide tables.
    partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    cols = columns or [c for c in numeric_columns(df, exclude=tuple(ID_COLUMNS) + tuple(exclude))
                       if c not in partition_by]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = f"CAST({_q(c)} AS DOUBLE)"
        if method == "zscore":
            aggs += [f"avg({x}) AS _a{i}", f"stddev_samp({x}) AS _b{i}"]
        else:
            aggs += [f"min({x}) AS _a{i}", f"max({x}) AS _b{i}"]
    if partition_by:
        stats = df.groupBy(*partition_by).agg(*[F.expr(a) for a in aggs])
    else:
        stats = df.selectExpr(*aggs)
    j = _attach(df, stats, partition_by)
    # Each normalised value is computed once, as its own column; the row
    # guard and the outputs refer to those columns (no repeated expressions).
    normed = []
    for i, c in enumerate(cols):
        x = f"CAST({_q(c)} AS DOUBLE)"
        d = f"_b{i}" if method == "zscore" else f"_b{i} - _a{i}"
        normed.append(f"nanvl(try_divide({x} - _a{i}, {d}), CAST(NULL AS DOUBLE)) AS _n{i}")
    j = j.selectExpr(*[_q(c) for c in df.columns], *normed)
    outs = {c: (f"CAST(CAST(bround(_n{i}, 1) AS BIGINT) AS DOUBLE)" if truncate else f"_n{i}")
            for i, c in enumerate(cols)}
    if parity:
        ok = " AND ".join(f"_n{i} IS NOT NULL" for i in range(len(cols)))
        j = j.selectExpr("*", f"({ok}) AS _ok")
        final = {c: f"CASE WHEN _ok THEN {outs[c]} ELSE CAST({_q(c)} AS DOUBLE) END" for c in cols}
    else:
        final = outs
    return j.selectExpr(*[f"{final[c]} AS {_q(c)}" if c in final else _q(c) for c in df.columns])


def zscore_normalize(df: DataFrame, exclude=("pass_rate",), partition_by=None,
                     truncate: bool = True, parity: bool = True, columns=None) -> DataFrame:
    """H1: (x - mean) / sample std for every numeric column but ``exclude``.

    ``parity``: a row where any column's result is undefined (NULL, NaN,
    division by zero) keeps all its raw values.  ``truncate``: round to one
    decimal, half-even, then truncate to an integer (the published tables).
    Results are DOUBLE.
    """
    return _normalize(df, "zscore", exclude, partition_by, truncate, parity, columns)


def minmax_normalize(df: DataFrame, exclude=("pass_rate",), partition_by=None,
                     truncate: bool = True, parity: bool = True, columns=None) -> DataFrame:
    """H2: (x - min) / (max - min), same rules as H1.  With ``parity`` a
    constant column leaves every row unchanged."""
    return _normalize(df, "minmax", exclude, partition_by, truncate, parity, columns)
