"""Per-pair metrics and the ``records`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.complexity import cyclomatic_complexity
from ..functions.distance import _similarity, edit_distance, ndiff_distance
from ..functions.header import header_fields
from ..functions.lines import LINE_CLASSES, PROFILE_FIELDS, comment_ratio, line_classes, line_profile
from ..functions.text import lines_of, py_strip
from ..session import materialize
from .ordinals import global_rank

SIDES = ("original", "updated")
PAIR_METRICS = PROFILE_FIELDS + ("levenshtein_distance", "syntactic_similarity",
                                 "cyclomatic_complexity")
HEADER_COLUMNS = ("repo_url", "repo_name", "path_to_snippet", "snippet_func_name",
                  "snippet_line_start", "snippet_line_end", "language", "run_command")


def metric_columns(sides=SIDES, metrics=PAIR_METRICS) -> list[str]:
    return [f"{s}_{m}" for s in sides for m in metrics]


def classify_lines(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """One row per line with its class ``blank`` / ``comment`` / ``loc``.

    The classes of a text's lines are made inside its row (``line_classes``)
    and the lines come out beside them: no shuffle and no window."""
    stripped = F.transform(F.col("_lines"), lambda l: py_strip(l))
    per_text = (df.select(*id_cols, lines_of(text_col).alias("_lines"))
                .select(*id_cols, "_lines", stripped.alias("_stripped"))
                .select(*id_cols, "_lines", "_stripped", line_classes("_stripped").alias("_class")))
    rows = per_text.select(*id_cols, F.posexplode(F.arrays_zip("_lines", "_stripped", "_class")).alias("pos", "_l"))
    cls = F.element_at(F.create_map(*[F.lit(x) for kv in LINE_CLASSES.items() for x in kv]), F.col("_l._class"))
    return rows.select(*id_cols, "pos", F.col("_l._lines").alias("line"), cls.alias("line_class"),
                       F.when(F.col("_l._class") == "l", F.length("_l._stripped")).otherwise(0).alias("chars"))


def _profile_cols(text_col: str, prefix: str) -> list:
    p = line_profile(text_col)
    return [p[f].alias(f"{prefix}_{f}") for f in PROFILE_FIELDS]


def dealt_by_cost(pairs: DataFrame, original: str, updated: str, parts: int | None = None) -> DataFrame:
    """``pairs`` over partitions of about equal cost for work that costs the
    product of the two lengths.

    Pairs are written with a row number; the numbers, ranked by cost over the
    cluster, are dealt in turn, so every partition gets its share of the dear and of
    the cheap ones and loads differ by one pair at most.  Partitions are named
    outright: hashing them would put two shares into one."""
    spark = pairs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("double")
    written = materialize(pairs.withColumn("_pair", F.monotonically_increasing_id()), "pairs-by-cost")
    cost = written.select("_pair", (size(original) * size(updated)).alias("_cost"))
    ranked = global_rank(cost, ["_cost", "_pair"], "_rank")
    # There and back again, so that the last of a round is not always the dearest.
    turn, at = F.expr(f"_rank div {parts}"), F.col("_rank") % parts
    part = F.when(turn % 2 == 0, at).otherwise(F.lit(parts - 1) - at).cast("int")
    return (written.join(ranked.select("_pair", part.alias("_part")), "_pair")
            .repartitionById(parts, "_part").drop("_pair", "_part"))


def pair_metrics(pairs: DataFrame, original: str = "original_block", updated: str = "updated_code",
                 distance: str = "levenshtein", fold: bool = False) -> DataFrame:
    """Profiles of both sides plus one distance and one similarity, stored
    on both sides.  ``distance='levenshtein'`` (E4/E5, native) or ``'ndiff'``
    (E6/E7, the run-based parity distance, Arrow UDF on whole texts).
    """
    if distance == "ndiff":
        if not pairs.isStreaming:               # a micro-batch keeps the partitions of its files
            pairs = dealt_by_cost(pairs, original, updated)
        d = ndiff_distance(original, updated)
    else:
        d = edit_distance(original, updated, fold=fold)
    # Distance and both profiles are computed once each, as their own columns.
    with_d = pairs.select("*", d.cast("long").alias("_distance"),
                          line_profile(original).alias("_po"), line_profile(updated).alias("_pu"))
    a, b = F.col(original), F.col(updated)
    sim = _similarity(F.col("_distance"), a, b)
    cols = [*pairs.columns]
    cols += [F.col(f"_po.{f}").alias(f"original_{f}") for f in PROFILE_FIELDS]
    cols += [F.col("_distance").alias("original_levenshtein_distance"), sim.alias("original_syntactic_similarity")]
    cols += [F.col(f"_pu.{f}").alias(f"updated_{f}") for f in PROFILE_FIELDS]
    cols += [F.col("_distance").alias("updated_levenshtein_distance"), sim.alias("updated_syntactic_similarity")]
    return with_d.select(*cols)


def metrics_diff(records: DataFrame, keys=("session_id", "idx"),
                 metrics=PROFILE_FIELDS) -> DataFrame:
    """Long table of the metrics whose original and updated values differ."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"),
                                 F.col(f"original_{m}").cast("double").alias("original"),
                                 F.col(f"updated_{m}").cast("double").alias("updated"))
                        for m in metrics])
    return (records.select(*keys, F.explode(entries).alias("_e"))
            .select(*keys, "_e.metric", "_e.original", "_e.updated")
            .filter(~F.col("original").eqNullSafe(F.col("updated"))))


def combine_metrics(df: DataFrame, original_cc, updated_cc, unknown: int | None = -1) -> DataFrame:
    """Attach complexity to both sides (a pair whose either side is
    unknown is unknown on both) and recompute the comment ratios."""
    void = original_cc.isNull() | updated_cc.isNull()
    fill = F.lit(unknown).cast("int") if unknown is not None else F.lit(None).cast("int")
    return (df.withColumn("original_cyclomatic_complexity",
                          F.when(void, fill).otherwise(original_cc.cast("int")))
            .withColumn("updated_cyclomatic_complexity",
                        F.when(void, fill).otherwise(updated_cc.cast("int")))
            .withColumn("original_comment_per_LOC", comment_ratio("original_comment", "original_LOC"))
            .withColumn("updated_comment_per_LOC", comment_ratio("updated_comment", "updated_LOC")))


RECORD_COLUMNS = (list(HEADER_COLUMNS) + metric_columns()
                  + ["original_code", "updated_code", "prompt", "session_id", "idx"])


def assemble_records(pairs: DataFrame, include_header: bool = True, distance: str = "levenshtein",
                     fold: bool = False, unknown_complexity: int | None = -1, keep=()) -> DataFrame:
    """D7-D11 + E9/E11: one record per pair.

    ``include_header=True`` measures the original as the raw block (header
    comment lines and the blank fence line included), as the published
    numbers were made; ``False`` measures the stripped ``original_code``.
    ``keep``: further columns of ``pairs`` to carry along.
    """
    from ..functions.header import header_parts
    split_once = pairs.select("session_id", "idx", "prompt", "original_block", "updated_code", *keep,
                              header_parts("original_block").alias("_hp"))
    hdr = header_fields(parts=F.col("_hp"))
    base = split_once.select("session_id", "idx", "prompt", "original_block", "updated_code", *keep,
                             *[hdr[c].alias(c) for c in HEADER_COLUMNS],
                             hdr["original_code"].alias("original_code"))
    measured = "original_block" if include_header else "original_code"
    m = pair_metrics(base, original=measured, updated="updated_code", distance=distance, fold=fold)
    m = combine_metrics(m, cyclomatic_complexity(F.col(measured)),
                        cyclomatic_complexity(F.col("updated_code")), unknown=unknown_complexity)
    return m.select(*RECORD_COLUMNS, *keep)
