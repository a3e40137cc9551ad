"""Aggregate reports over ``records``.

Every report is a ``groupBy`` (partial aggregation before the shuffle) or a
global aggregate (one row, broadcast).  Per-repository tables are one grouped
job over all repositories, not a loop.  Rounding is half-even (``bround``),
division by zero gives NULL (``try_divide``) where the original produced
inf/NaN; NULL is skipped by ``avg``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexity import cyclomatic_complexity
from ..functions.lines import PROFILE_FIELDS, line_profile
from ..session import checked_broadcast, materialize
from .codemetrics import PAIR_METRICS
from .columns import (CATEGORY_RENAMES, ID_COLUMNS, drop_columns_with, encode_prompts,
                      feature_order, label_prompts, numeric_columns, pair_columns,
                      shorten_names)
from .extract import clean_prompts
from .normalize import minmax_normalize
from .ordinals import quantiles as exact_quantiles

CATEGORY_KEYWORDS = ("pass_rate", "cyclomatic_complexity", "LOC", "comment")
CATEGORY_DROP = ("min", "max", "mean", "code", "comment_per_LOC")
STAT_DROP = ("min", "max", "mean")
DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def _scalar(x, name: str) -> DataFrame | None:
    """An int / float parameter or a one-row DataFrame holding it."""
    if isinstance(x, DataFrame):
        # One row whatever is handed in: a second row would double the report.
        return F.broadcast(x.agg(F.max(x.columns[0]).cast("double").alias(name)))
    return None


def _with_scalar(df: DataFrame, x, name: str) -> tuple[DataFrame, Column]:
    s = _scalar(x, name)
    if s is None:
        return df, F.lit(float(x))
    return df.crossJoin(s), F.col(name)


def _round(c: Column, digits) -> Column:
    return c if digits is None else F.bround(c, digits)


def _mean(c: Column) -> Column:
    """``avg``, except that a group whose values are all equal gets exactly
    that value (a floating sum of equal values can drift in its last bit)."""
    return F.when(F.min(c) == F.max(c), F.min(c).cast("double")).otherwise(F.avg(c))


def _nunique(df: DataFrame, col: str, name: str) -> DataFrame:
    return F.broadcast(df.agg(F.count_distinct(col).cast("double").alias(name)))


# ---------------------------------------------------------------- I1 / I2 / I3

def add_group_stats(df: DataFrame, key: str = "repo_name", columns=None,
                    stats=("min", "max", "mean"), digits=None) -> DataFrame:
    """``<col>_min/_max/_mean`` of every numeric column per ``key``,
    attached to each row: a grouped aggregate, written, and broadcast where its
    bytes allow, so the wide rows are not shuffled on a handful of keys."""
    cols = columns or [c for c in numeric_columns(df) if c not in ("pass_rate",)]
    fns = {"min": "min({})", "max": "max({})", "mean": "avg({})"}
    aggs = []
    for c in cols:
        for s in stats:
            v = fns[s].format(f"`{c}`")
            if s == "mean" and digits is not None:
                v = f"bround({v}, {digits})"
            aggs.append(F.expr(f"{v} AS `{c}_{s}`"))
    g = materialize(df.groupBy(key).agg(*aggs), "group-stats")
    return df.join(checked_broadcast(g), key, "left")


def add_pass_rate(df: DataFrame, snippet_count, keys=("repo_name", "prompt_id"),
                  out: str = "pass_rate") -> DataFrame:
    """Rows per key group / snippet count * 100, one decimal, on each row."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts, sc = _with_scalar(counts, snippet_count, "_snippets")
    counts = materialize(counts.select(*keys, F.bround((F.col("_n") / sc) * 100, 1).alias(out)), "pass-rates")
    return df.join(checked_broadcast(counts), keys, "left")


def rescale_pass_rate(df: DataFrame, group_col: str | None = None, col: str = "pass_rate") -> DataFrame:
    """Pass rate times the number of distinct ``group_col`` values, or
    divided by 100 when no group column is given."""
    if group_col is None:
        return df.withColumn(col, F.col(col) / 100)
    j = df.crossJoin(_nunique(df, group_col, "_nu"))
    return j.withColumn(col, F.col(col) * F.col("_nu")).drop("_nu")


def max_group_count(df: DataFrame, keys=("repo_name", "prompt_id"), name: str = "snippet_count") -> DataFrame:
    """Largest number of rows in one key group, as a one-row DataFrame."""
    return df.dropna(subset=list(keys)).groupBy(*keys).count().agg(F.max("count").alias(name))


def score_records(records: DataFrame, snippet_count=None, group_by: str = "prompt_id",
                  with_group_stats: bool = True, stats_digits=None, labels: dict | None = None) -> DataFrame:
    """The report input: D12 -> G1 -> G2 -> I2 (-> I1), in that order.

    ``labels`` maps prompt ids to labels (default: the published ones); a
    prompt without a label is its own label, so no record leaves the reports.
    """
    df = label_prompts(encode_prompts(clean_prompts(records)), labels=labels, fallback_col="prompt")
    if snippet_count is None:
        snippet_count = max_group_count(df, ("repo_name", group_by))
    df = add_pass_rate(df, snippet_count, keys=("repo_name", group_by))
    if with_group_stats:
        df = add_group_stats(df, "repo_name", columns=[f"{s}_{m}" for s in ("original", "updated")
                                                       for m in PAIR_METRICS], digits=stats_digits)
    return df


# --------------------------------------------------------------------- I4

def describe(records: DataFrame, columns=None, quantiles: str = "exact",
             accuracy: int = 100_000) -> DataFrame:
    """I4: count, mean, sample std, min, exact quartiles, max per metric.

    Inputs are rounded to one decimal first and every statistic again after.
    Long form: one row per statistic, one column per metric (short names).
    Quartiles (linear interpolation, as pandas) come from counts per column and
    value over range partitions (``ordinals.quantiles``), so no task holds a
    column's values.  ``quantiles='approx'`` uses ``percentile_approx`` with the
    given accuracy instead, whose state is a fixed-size sketch.
    """
    cols = columns or [f"{s}_{m}" for m in PAIR_METRICS for s in ("original", "updated")]
    base = pair_columns(records.selectExpr(*[f"bround(CAST(`{c}` AS DOUBLE), 1) AS `{c}`" for c in cols]))
    base = shorten_names(base, style="describe")
    names = base.columns
    aggs = []
    for i, c in enumerate(names):
        x = f"`{c}`"
        aggs += [f"CAST(count({x}) AS DOUBLE) AS _c{i}", f"avg({x}) AS _m{i}", f"stddev_samp({x}) AS _s{i}",
                 f"min({x}) AS _lo{i}", f"max({x}) AS _hi{i}"]
        if quantiles != "exact":
            aggs.append(f"percentile_approx({x}, array(0.25, 0.5, 0.75), {int(accuracy)}) AS _q{i}")
    one = base.selectExpr(*aggs)
    if quantiles == "exact":
        one = one.crossJoin(F.broadcast(exact_quantiles(base, names, [0.25, 0.5, 0.75])))   # one row each
    stat = {"count": "_c{i}", "mean": "_m{i}", "std": "_s{i}", "min": "_lo{i}", "25%": "_q{i}[0]",
            "50%": "_q{i}[1]", "75%": "_q{i}[2]", "max": "_hi{i}"}
    rows = ", ".join(
        "named_struct('statistic', '" + s + "', "
        + ", ".join(f"'{c}', bround({stat[s].format(i=i)}, 1)" for i, c in enumerate(names)) + ")"
        for s in DESCRIBE_STATS)
    return one.selectExpr(f"explode(array({rows})) AS _r").select("_r.*")


# ---------------------------------------------------------------- I5 / I6 / I7

def _category_base(df: DataFrame, key: str, design_size) -> tuple[DataFrame, Column]:
    d = drop_columns_with(df, CATEGORY_DROP).filter(F.col(key).isNotNull())
    d = d.crossJoin(_nunique(d, key, "_nkeys"))
    d, ds = _with_scalar(d, design_size, "_design")
    return d, ds / F.col("_nkeys")


def category_table(df: DataFrame, key: str, design_size, keywords=CATEGORY_KEYWORDS,
                   digits: int = 1) -> DataFrame:
    """Per key, pass rate = rows / (design size / number of keys), the
    means of the kept numeric columns, and the number of rows.  Names use
    og/up for original/updated."""
    d, per_key = _category_base(df, key, design_size)
    keep = [c for c in numeric_columns(d, exclude=tuple(ID_COLUMNS) + ("_nkeys", "_design"))
            if any(k in c for k in keywords) and c not in (key, "pass_rate")]
    # Pairwise order (original next to updated), as the published tables.
    def pair_key(c: str):
        side, _, metric = c.partition("_")
        rank = PAIR_METRICS.index(metric) if metric in PAIR_METRICS else len(PAIR_METRICS)
        return (rank, side != "original", c)
    keep = sorted(keep, key=pair_key)
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("num_elements"), F.max(per_key).alias("_per_key"),
                           *[F.avg(c).alias(c) for c in keep])
    return g.select(key, F.bround(F.col("num_elements") / F.col("_per_key"), digits).alias("pass_rate"),
                    *[F.bround(F.col(c), digits).alias(c.replace("original", "og").replace("updated", "up"))
                      for c in keep],
                    F.col("num_elements").cast("long").alias("num_elements"))


def category_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key plus the grand total (``is_total``) via ``rollup``."""
    return (df.filter(F.col(key).isNotNull()).rollup(key)
            .agg(F.count(F.lit(1)).cast("long").alias("num_elements"),
                 (F.grouping(key) == 1).alias("is_total")))


def category_pct_change(df: DataFrame, key: str, design_size, digits: int = 1) -> DataFrame:
    """Mean of per-row percent changes (updated - original) / original
    * 100 per key, plus the pass rate in percent.  Mean of ratios: compare
    I11, which is the ratio of means."""
    d, per_key = _category_base(df, key, design_size)
    d = d.withColumn("_per_key", per_key)
    for old, new in CATEGORY_RENAMES.items():
        if old in d.columns:
            d = d.withColumnRenamed(old, new)
    nums = set(numeric_columns(d))
    pct = []
    for c in d.columns:
        if c.startswith("original_"):
            u = "updated_" + c[len("original_"):]
            if c in nums and u in nums:
                name = c[len("original_"):]
                pct.append(F.try_divide(F.col(u) - F.col(c), F.col(c).cast("double")) * 100)
                pct[-1] = pct[-1].alias(name)
    rowwise = d.select(key, "_per_key", *pct)
    metric_names = [c for c in rowwise.columns if c not in (key, "_per_key")]
    # The pass rate is one value per key: it comes from the same aggregate.
    rate = F.count(F.lit(1)) / F.max("_per_key") * 100
    return rowwise.groupBy(key).agg(F.bround(rate, digits).alias("pass_rate"),
                                    *[F.bround(F.avg(c), digits).alias(c) for c in metric_names])


# ---------------------------------------------------------------- I8 / I9

ORIGINAL_METRICS = [f"original_{m}" for m in PAIR_METRICS]
TABLE_COLUMNS = ["pass_rate"] + list(PAIR_METRICS)
NULL_IN_BASELINE = ("pass_rate", "levenshtein_distance", "syntactic_similarity")


def _as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def baseline_row(df: DataFrame, partition_by=None, order_cols=("session_id", "idx"),
                 pass_col: str = "pass_rate", digits=None) -> DataFrame:
    """I8: the original-side metrics of the first row (by ``order_cols``)
    whose pass rate is exactly 100, per partition.  Pass rate, distance and
    similarity are NULL in this row.  Partitions without such a row are absent."""
    part = _as_list(partition_by)
    first = (df.filter(F.col(pass_col) == 100).groupBy(*part)
             .agg(F.min_by(F.struct(*[F.col(c) for c in ORIGINAL_METRICS]),
                           F.struct(*[F.col(c) for c in order_cols])).alias("_b")))
    cols = []
    for m in TABLE_COLUMNS:
        if m in NULL_IN_BASELINE:
            cols.append(F.lit(None).cast("double").alias(m))
        else:
            cols.append(_round(F.col(f"_b.original_{m}").cast("double"), digits).alias(m))
    return first.select(*part, *cols)


def distinct_texts(df: DataFrame, part: list[str], text: str) -> DataFrame:
    """Distinct rows of ``part`` and ``text``, grouped by a 128-bit digest of the
    text and never by the text itself.  The least and the greatest text of a digest
    are compared: two texts that share one both come out, and a third is an error
    rather than a lost row."""
    digest = F.unhex(F.md5(F.col(text).cast("binary"))).alias("_digest")
    ends = df.select(*part, text, digest).groupBy(*part, "_digest").agg(
        F.min(text).alias("_least"), F.max(text).alias("_most"), F.size(F.collect_set(F.xxhash64(text))).alias("_kinds"))
    texts = (F.when(F.col("_kinds") > 2, F.raise_error(F.lit("three texts share a digest")).cast("array<string>"))
             .when(F.col("_least").eqNullSafe(F.col("_most")), F.array("_least")).otherwise(F.array("_least", "_most")))
    return ends.select(*part, F.explode(texts).alias(text))


def baseline_from_distinct(df: DataFrame, partition_by=None, parity: bool = True,
                           digits=None) -> DataFrame:
    """Means of the line profile over the *distinct* original codes, per
    partition.  Complexity is -1 in parity mode (the original tool measured
    it on single characters and never found a function), else the mean E8
    complexity with unknown as -1."""
    part = _as_list(partition_by)
    distinct = distinct_texts(df.select(*part, "original_code"), part, "original_code")
    p = line_profile("original_code")
    cc = (F.lit(-1.0) if parity
          else F.coalesce(cyclomatic_complexity("original_code"), F.lit(-1)).cast("double"))
    prof = distinct.select(*part, *[p[f].alias(f) for f in PROFILE_FIELDS], cc.alias("cyclomatic_complexity"))
    aggs = []
    for m in TABLE_COLUMNS:
        if m in NULL_IN_BASELINE:
            aggs.append(F.lit(None).cast("double").alias(m))
        else:
            aggs.append(_round(F.avg(F.col(m).cast("double")), digits).alias(m))
    return (prof.groupBy(*part) if part else prof).agg(*aggs)


def baseline(df: DataFrame, partition_by=None, digits=None, parity: bool = True) -> DataFrame:
    """I8 where a partition has a row at 100, else I9 (whole-row choice)."""
    part = _as_list(partition_by)
    b8 = baseline_row(df, part, digits=digits).withColumn("_has8", F.lit(True))
    b9 = baseline_from_distinct(df, part, parity=parity, digits=digits)
    b8r = b8.select(*part, "_has8", *[F.col(m).alias(f"_8_{m}") for m in TABLE_COLUMNS])
    # Without partitions both sides are global aggregates of one row.
    j = b9.join(b8r, part, "left") if part else b9.join(F.broadcast(b8r), F.lit(True), "left")
    has8 = F.coalesce(F.col("_has8"), F.lit(False))
    return j.select(*part, *[F.when(has8, F.col(f"_8_{m}")).otherwise(F.col(m)).alias(m)
                             for m in TABLE_COLUMNS])


# ---------------------------------------------------------------- I10-I14

def summary_table(df: DataFrame, kind: str = "abs", partition_by: str = "repo_name",
                  group_by: str = "prompt_id", pre_normalize: bool = False,
                  baseline_digits=None, round_pass_rate: bool = False,
                  skip_containing: str | None = None, rescale: bool = True) -> DataFrame:
    """Per partition, a baseline row (``row_label='Original'``) and
    one row per ``group_by`` value.

    ``kind``: ``abs`` (I10, group means of updated metrics), ``normalized``
    (I13, min-max per partition first), ``percentage`` (I11, ratio of means
    (up - og) / og * 100) or ``factor`` (I12, up / og * 100).  Pass rate is
    first multiplied by the number of distinct ``group_by`` values (I3).
    I14 is this with ``partition_by == group_by``, ``pre_normalize``,
    ``baseline_digits=1``, ``round_pass_rate`` and ``skip_containing``.
    """
    d = df.filter(F.col(partition_by).isNotNull())
    if rescale:
        d = rescale_pass_rate(d, group_by)
    if pre_normalize:
        d = minmax_normalize(d)
    if skip_containing is not None:
        d = d.filter(~F.coalesce(F.col(partition_by).cast("string").contains(skip_containing), F.lit(False)))
    if kind == "normalized":
        d = minmax_normalize(d, partition_by=partition_by)
    d = drop_columns_with(d, STAT_DROP)
    keys = [partition_by] if partition_by == group_by else [partition_by, group_by]
    base = baseline(d, partition_by, digits=baseline_digits).select(
        partition_by, F.lit("Original").alias("row_label"), F.lit(0).alias("row_kind"),
        *[F.col(m) for m in TABLE_COLUMNS])
    g = d.filter(F.col(group_by).isNotNull())
    if kind in ("abs", "normalized"):
        aggs = [F.bround(F.avg("pass_rate"), 1).alias("pass_rate")]
        aggs += [F.bround(F.avg(F.col(f"updated_{m}").cast("double")), 1).alias(m) for m in PAIR_METRICS]
        rows = g.groupBy(*keys).agg(*aggs)
    else:
        if round_pass_rate:
            # Mean of one-decimal values: an exact integer sum of tenths, one division.
            tenths = F.bround(F.bround(F.col("pass_rate"), 1) * 10, 0).cast("long")
            pr_mean = F.try_divide(F.sum(tenths), F.count(tenths)) / 10
        else:
            pr_mean = _mean(F.col("pass_rate"))
        aggs = [pr_mean.alias("pass_rate")]
        for m in PAIR_METRICS:
            aggs += [F.avg(F.col(f"updated_{m}").cast("double")).alias(f"_u_{m}"),
                     F.avg(F.col(f"original_{m}").cast("double")).alias(f"_o_{m}")]
        rows = g.groupBy(*keys).agg(*aggs)
        vals = []
        for m in PAIR_METRICS:
            u, o = F.col(f"_u_{m}"), F.col(f"_o_{m}")
            v = (F.try_divide(u - o, o) * 100) if kind == "percentage" else (F.try_divide(u, o) * 100)
            vals.append(F.bround(v, 1).alias(m))
        rows = rows.select(*keys, "pass_rate", *vals)
    rows = rows.select(partition_by, F.col(group_by).cast("string").alias("row_label"),
                       F.lit(1).alias("row_kind"), *[F.col(m) for m in TABLE_COLUMNS])
    return base.unionByName(rows)


def prompt_table_abs(df: DataFrame, partition_by="repo_name", group_by="prompt_id",
                     baseline_digits=None) -> DataFrame:
    """I10."""
    return summary_table(df, "abs", partition_by, group_by, baseline_digits=baseline_digits)


def prompt_table_pct(df: DataFrame, partition_by="repo_name", group_by="prompt_id",
                     baseline_digits=None) -> DataFrame:
    """I11."""
    return summary_table(df, "percentage", partition_by, group_by, baseline_digits=baseline_digits)


def prompt_table_factor(df: DataFrame, partition_by="repo_name", group_by="prompt_id",
                        baseline_digits=None) -> DataFrame:
    """I12."""
    return summary_table(df, "factor", partition_by, group_by, baseline_digits=baseline_digits)


def prompt_table_normalized(df: DataFrame, partition_by="repo_name", group_by="prompt_id",
                            baseline_digits=None) -> DataFrame:
    """I13."""
    return summary_table(df, "normalized", partition_by, group_by, baseline_digits=baseline_digits)


def element_summary(df: DataFrame, element: str = "language", kind: str = "abs") -> DataFrame:
    """The I10-I13 tables with one element (language or prompt) per
    partition; languages containing ``// c++`` are skipped."""
    return summary_table(df, kind, partition_by=element, group_by=element, pre_normalize=True,
                         baseline_digits=1, round_pass_rate=True, skip_containing="// c++")


# ---------------------------------------------------------------- I15 / I16 / I17

def _report_numeric(d: DataFrame, keys) -> list[str]:
    return [c for c in numeric_columns(d) if c not in keys]


def change_matrix(df: DataFrame, partition_by: str = "repo_name", group_by: str = "prompt_id",
                  digits=None) -> DataFrame:
    """Heat-map numbers.  Pass rate / 100, min-max normalisation, then
    per row (updated - original) / original for each metric pair, averaged
    per (partition, group)."""
    d = rescale_pass_rate(df)
    d = minmax_normalize(d)
    d = drop_columns_with(d, ("min", "max", "mean", "code"))
    nums = set(numeric_columns(d))
    rel = []
    for c in d.columns:
        if c.startswith("original_"):
            u = "updated_" + c[len("original_"):]
            if c in nums and u in nums:
                rel.append(F.try_divide(F.col(u) - F.col(c), F.col(c).cast("double")).alias(c[len("original_"):]))
    d = d.select(partition_by, group_by, "pass_rate", *rel)
    keys = [partition_by, group_by]
    return (d.filter(F.col(group_by).isNotNull()).groupBy(*keys)
            .agg(*[_round(_mean(F.col(c)), digits).alias(c) for c in _report_numeric(d, keys)]))


def feature_distribution(df: DataFrame, partition_by: str = "repo_name", group_by: str = "prompt_id",
                         digits=None) -> DataFrame:
    """I16: normalised means per (partition, group, feature) in long form,
    ``ord`` in paired feature order (G9)."""
    d = minmax_normalize(df)
    d = rescale_pass_rate(d, group_by)
    d = d.withColumn("pass_rate", F.col("pass_rate") / 100)
    d = drop_columns_with(d, STAT_DROP)
    keys = [partition_by, group_by]
    feats = feature_order(_report_numeric(d, keys))
    means = (d.filter(F.col(group_by).isNotNull()).groupBy(*keys)
             .agg(*[_mean(F.col(c).cast("double")).alias(c) for c in feats]))
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ord"),
                                 _round(F.col(f), digits).alias("value"))
                        for i, f in enumerate(feats)])
    return means.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.feature", "_e.ord", "_e.value")


def distinct_keys(df: DataFrame, cols) -> DataFrame:
    """I17."""
    return df.select(*_as_list(cols)).distinct()
