"""Records from a stream of transcript files (Structured Streaming).

A transcript file holds one whole session (a JSON array of messages), so
pairing a user message with the answer after it needs no window and no state:
it is an array operation inside the row.  Everything after that (header
fields, line profiles, distances, complexity) is per-row, so the stage-2
pipeline runs unchanged as a stateless streaming query: each micro-batch of
new files becomes appended record rows, and the checkpoint makes the sink
exactly-once.  Aggregate reports stay batch jobs over the written records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.codemetrics import assemble_records
from ..operators.extract import turns_to_pairs
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.files import MESSAGE_SCHEMA, list_by_core


RUN_KEYS = ("model", "run_ts")


def transcript_turns(text: Column) -> Column:
    """Array of ``struct(idx, prompt, user_content, answer_content)``: each
    user message followed by an assistant message, from one transcript."""
    msgs = F.from_json(text, MESSAGE_SCHEMA)
    n = F.size(msgs)
    idxs = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    both = F.transform(idxs, lambda i: F.struct(
        i.cast("long").alias("idx"), msgs[i]["prompt"].alias("prompt"),
        msgs[i]["role"].alias("r1"), msgs[i + 1]["role"].alias("r2"),
        msgs[i]["content"].alias("user_content"), msgs[i + 1]["content"].alias("answer_content")))
    return F.filter(both, lambda t: (t["r1"] == "user") & (t["r2"] == "assistant"))


def records_from_files(files: DataFrame, session_col: Column, include_header: bool = True,
                       distance: str = "levenshtein", fold: bool = False) -> DataFrame:
    """``files(value, file_path)`` (batch or streaming) -> records, with the
    ``model`` and ``run_ts`` of the run's folder: a session has a record set per run."""
    run = [F.regexp_extract("file_path", rf"/{k}=([^/]+)/", 1).alias(k) for k in RUN_KEYS]
    turns = (files.select(session_col.alias("session_id"), *run, F.explode(transcript_turns(F.col("value"))).alias("_t"))
             .select("session_id", *RUN_KEYS, "_t.idx", F.coalesce("_t.prompt", F.lit("")).alias("prompt"),
                     "_t.user_content", "_t.answer_content"))
    return assemble_records(turns_to_pairs(turns, keep=RUN_KEYS), include_header=include_header,
                            distance=distance, fold=fold, keep=RUN_KEYS)


def session_from_path(path_col: str = "file_path") -> Column:
    """Session id from a ``session_id=<n>`` folder in the path, else the
    file name."""
    sid = F.regexp_extract(F.col(path_col), r"session_id=([^/]+)", 1)
    name = F.regexp_extract(F.col(path_col), r"([^/]+)$", 1)
    return F.when(sid != "", sid).otherwise(name)


def read_transcript_stream(spark: SparkSession, in_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    list_by_core(spark)
    return (spark.readStream.format("text").option("wholetext", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).option("recursiveFileLookup", True)
            .load(in_dir).select("value", F.col("_metadata.file_path").alias("file_path")))


def start_records_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str | None = None,
                         available_now: bool = True, **kw) -> StreamingQuery:
    """Append records for every new transcript file under ``in_dir`` to the
    parquet folder ``out_dir``.  The checkpoint lives in the shared
    checkpoint folder unless given."""
    ensure_checkpoint_dir(spark)
    ck = checkpoint or scratch_path(spark, "records-stream-ckpt")
    recs = records_from_files(read_transcript_stream(spark, in_dir), session_from_path(), **kw)
    w = recs.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ck).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
