"""Build outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, lines_of
from ..session import checked_broadcast, materialize

# The phrase a successful build log contains.
BUILD_OK_PHRASE = "Build succeeded"


# What ends a line besides a newline.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def split_lines(text) -> Column:
    """``text.splitlines()``: a final line end opens no further line; '' has none."""
    c = col_(text)
    ends = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    lines = F.split(ends, "\n", -1)
    return F.when(c == "", F.array().cast("array<string>")).when(
        ends.endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def splice_lines(files: DataFrame, records: DataFrame, base: int = 0, repo_col: str = "repo_name",
                 path_col: str = "path", text_col: str = "text") -> DataFrame:
    """replace lines ``start..end`` (inclusive) of the file by the lines
    of the updated code; skipped (file unchanged) when start or end is NULL.

    A file is known by repository and path: repositories share path names.
    ``base=0`` reads the header numbers as 0-based slice positions (as the
    original tool did), ``base=1`` as 1-based line numbers.  Line ends are
    kept.  One output row per record whose file is there.

    Which files are asked for is found on names alone, and broadcast where their
    bytes allow: texts of other files are neither made nor moved.
    """
    wanted = materialize(records.select(F.col("repo_name").alias(repo_col), F.col("path_to_snippet").alias(path_col)).distinct(), "spliced-files")
    files = files.join(checked_broadcast(wanted), [repo_col, path_col], "left_semi")
    j = records.select("session_id", "idx", F.col("repo_name").alias(repo_col), F.col("path_to_snippet").alias(path_col),
                       "snippet_line_start", "snippet_line_end", "updated_code").join(
        files.select(repo_col, path_col, text_col), [repo_col, path_col], "inner")
    lines = lines_of(text_col)
    upd = split_lines("updated_code")
    start = F.greatest(F.col("snippet_line_start") - base, F.lit(0))
    end = F.col("snippet_line_end") - base
    tail_from = F.greatest(start, end + 1)
    n = F.size(lines)
    spliced = F.concat(F.slice(lines, 1, start), upd,
                       F.slice(lines, tail_from + 1, F.greatest(n, F.lit(1))))
    ok = F.col("snippet_line_start").isNotNull() & F.col("snippet_line_end").isNotNull()
    out = F.when(ok, F.array_join(spliced, "\n")).otherwise(F.col(text_col))
    return j.select("session_id", "idx", repo_col, path_col, out.alias("spliced_text"))


def classify_build_log(outcomes: DataFrame, exit_col: str = "exit_code", log_col: str = "log") -> DataFrame:
    """0 when the command failed, 1 when the log has the success phrase,
    NULL otherwise (the build ran but said nothing conclusive).  Tests are
    never run: the result of a processed record is ''."""
    bs = (F.when(F.col(exit_col) != 0, F.lit(0))
          .when(F.col(log_col).contains(BUILD_OK_PHRASE), F.lit(1)))
    return outcomes.select(*[c for c in outcomes.columns if c not in (exit_col, log_col)],
                           bs.cast("int").alias("build_success"),
                           F.lit("").alias("test_success"))


def attach_build_outcome(records: DataFrame, outcomes: DataFrame, on=("session_id", "idx")) -> DataFrame:
    """records left-joined with classified outcomes, one per key: two
    outcomes of a record are an error, not two records."""
    keys, fields = list(on), ("build_success", "test_success")
    one = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in fields])
    checked = one.select(*keys, *[F.when(F.col("_n") == 1, F.col(c)).otherwise(
        F.raise_error(F.lit("more than one build outcome for a record")).cast(outcomes.schema[c].dataType)).alias(c)
        for c in fields])
    return records.drop(*fields).join(checked, keys, "left")


def build_summary(df: DataFrame, by=None) -> DataFrame:
    """succeeded / failed / unknown counts, overall or per key."""
    keys = [by] if isinstance(by, str) else list(by or [])
    bs = F.col("build_success")
    return (df.groupBy(*keys) if keys else df).agg(
        F.count_if(bs == 1).cast("long").alias("builds_succeeded"),
        F.count_if(bs == 0).cast("long").alias("builds_failed"),
        F.count_if(bs.isNull()).cast("long").alias("builds_unknown"))
