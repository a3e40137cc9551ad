"""File sinks.

Writers keep the rows distributed.  Sessions and transcripts are written as
lines, one turn or message a line with its session beside it: as many files as
tasks, splittable, no shuffle by session.  One file per session is an export.  A
dictionary or a report table is written as a single file, streamed row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import on_disk, write_folders
from ..operators.ordinals import running_total

LAYOUTS = ("lines", "files")


def _check(layout: str) -> None:
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")


def write_session_markdown(turns: DataFrame, path: str, session_col: str = "session",
                           order_col: str = "ord", text_col: str = "text", mode: str = "overwrite",
                           layout: str = "files") -> None:
    """B1: session markdown, turns in ``order_col`` order.  ``mode="append"``
    adds to what was written before.

    ``layout="files"``: the export, one markdown file per session.  One row per
    turn is written (the text writer ends every row with a newline, so each
    turn's own final newline is dropped first); rows are clustered by session
    and sorted, never collected into one value.  ``"lines"``: JSON lines
    ``session, ord, text``, as many files as tasks; ``scan_session_markdown``
    reads both.
    """
    _check(layout)
    if layout == "lines":
        (turns.select(F.col(session_col).cast("string").alias("session"), F.col(order_col).cast("long").alias("ord"),
                      F.col(text_col).alias("text")).write.mode(mode).json(path))
        return
    body = F.regexp_replace(F.col(text_col), r"\n\z", "")
    (turns.select(session_col, order_col, body.alias("value"))
     .repartition(session_col).sortWithinPartitions(session_col, order_col)
     .select(session_col, "value")
     .write.mode(mode).partitionBy(session_col).text(path))


def _partition_value(v: str) -> str:
    """A partition folder value; Spark decodes ``%XX`` when it reads it back."""
    from urllib.parse import quote
    return quote(v, safe="-_.")


# The sessions of each run, beside its messages: what a reader needs to choose runs.
# The name begins with "_", so Spark does not take the folder for data.
SESSION_INDEX = "_sessions"


def write_chat_json(messages: DataFrame, path: str, model: str, run_ts: str,
                    session_col: str = "session_id", layout: str = "lines") -> None:
    """B2: the transcripts of one run, below
    ``model=<m>/run_ts=<yyyy-MM-dd_HH-mm>/``.  A run is written to its own folder,
    so writing it again replaces only that run and earlier runs stay.

    ``layout="lines"``: JSON lines ``session_id, idx, role, content, prompt``, one
    message a line, ``idx`` its place in the session (counted in two levels, so a
    very long session is spread), as many files as tasks.  The session index, one
    row per session, goes to ``_sessions`` with the same folders.

    ``layout="files"``: the export, one file per session below
    ``<session_col>=<s>/`` holding a JSON array.  Each message is its own row,
    framed ``[`` / ``,`` / ``]`` by the session's first and last index, so a
    session streams through its writer task row by row; the rows form a valid
    array because newlines between elements are whitespace.  On a disk the tasks
    write the files themselves (``write_folders``); elsewhere Spark's writer does.
    """
    _check(layout)
    run = f"model={_partition_value(model)}/run_ts={_partition_value(run_ts)}"
    run_dir = f"{path.rstrip('/')}/{run}"
    if layout == "lines":
        m = messages.select(F.col(session_col).cast("string").alias("session_id"), F.col("idx").cast("long").alias("idx"),
                            "role", "content", "prompt")
        placed = running_total(m.withColumn("one", F.lit(1)), ["session_id"], "idx", "one", "place")
        (placed.select("session_id", F.col("place").alias("idx"), "role", "content", "prompt")
         .write.mode("overwrite").json(run_dir))
        (m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))
         .write.mode("overwrite").parquet(f"{path.rstrip('/')}/{SESSION_INDEX}/{run}"))
        return
    bounds = messages.groupBy(session_col).agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    elem = F.to_json(F.struct("role", "content", "prompt"))
    line = F.concat(F.when(F.col("idx") == F.col("_lo"), F.lit("[")).otherwise(F.lit(",")), elem,
                    F.when(F.col("idx") == F.col("_hi"), F.lit("]")).otherwise(F.lit("")))
    rows = messages.join(bounds, session_col).select(session_col, "idx", line.alias("value"))
    folder = on_disk(messages.sparkSession, run_dir)
    if folder:
        write_folders(rows, session_col, "idx", "value", folder)
        return
    (rows.repartition(session_col).sortWithinPartitions(session_col, "idx")
     .select(session_col, "value")
     .write.mode("overwrite").partitionBy(session_col).text(run_dir))


def write_records(records: DataFrame, path: str, fmt: str = "parquet",
                  partition_by=None) -> None:
    """The records table as parquet or JSON lines."""
    w = records.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.format(fmt).save(path)


def write_prompt_mapping(dictionary: DataFrame, path: str, key_col: str = "prompt",
                         id_col: str = "prompt_ord") -> None:
    """The ``{prompt: id}`` dictionary as one JSON object, ids in order.

    One entry a row, framed ``{`` / ``,`` / ``}``: the writer task streams the
    sorted rows into a single file and never holds the object."""
    bounds = F.broadcast(dictionary.agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi")))  # one row
    entry = F.to_json(F.create_map(F.col(key_col), F.col(id_col)))
    line = F.concat(F.when(F.col(id_col) == F.col("_lo"), F.lit("{")).otherwise(F.lit(",")),
                    F.substring(entry, F.lit(2), F.length(entry) - 2),
                    F.when(F.col(id_col) == F.col("_hi"), F.lit("}")).otherwise(F.lit("")))
    (dictionary.crossJoin(bounds).select(id_col, line.alias("value")).coalesce(1).sortWithinPartitions(id_col)
     .select("value").write.mode("overwrite").text(path))


def write_report_csv(report: DataFrame, path: str, order_by=None, single_file: bool = True) -> None:
    """A report as CSV with a header, in one file (reports have one row per
    key) or, with ``single_file=False``, in one file per task."""
    df = report.orderBy(*order_by) if order_by else report
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
