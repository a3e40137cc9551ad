"""The three stages of the original tool as Spark jobs over files.

* ``sessions_stage``: snippet files x prompt list -> session markdown files.
* ``metrics_stage``:  transcript files (latest run per session and model) ->
  the records table (parquet or JSON lines).
* ``build_stage``:    records + build outcomes -> records with their outcome.
* ``reports_stage``:  records -> the report tables (CSV) and the prompt
  dictionary (JSON), named as the original tool named them.

Command line::

    python -m codeshift.plans.stages sessions SNIPPETS_DIR PROMPTS_FILE OUT_DIR
    python -m codeshift.plans.stages metrics TRANSCRIPTS_DIR OUT_DIR [--model M]
    python -m codeshift.plans.stages build RECORDS_DIR OUTCOMES_DIR OUT_DIR
    python -m codeshift.plans.stages reports RECORDS_DIR OUT_DIR --design-size N
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as rp
from ..operators.codemetrics import assemble_records
from ..operators.columns import prompt_dictionary
from ..operators.extract import clean_prompts, extract_pairs, zip_pairs
from ..operators.ordinals import first_appearance_index
from ..operators.outcomes import attach_build_outcome, classify_build_log
from ..operators.sessions import cross_prompts, render_turn
from ..session import checked_broadcast, ensure_checkpoint_dir, materialize
from ..sinks import files as sinks
from ..sources import files as src

# Report file layout of the original tool.
CATEGORY_FILES = {"prompt_id": "prompt/TABLE_prompt_id.csv", "language": "language/TABLE_language.csv",
                  "repo_name": "repo/TABLE_repo_name.csv"}
SUMMARY_FILE = "summary_table.csv"
MAPPING_FILE = "prompt/prompt_mapping.json"


def sessions_stage(spark: SparkSession, snippets_path: str, prompts_path: str, out_dir: str,
                   one_session: bool = False, layout: str = "files") -> DataFrame:
    """Every snippet with every prompt, rendered as user turns and written as
    session markdown.  By default each snippet's turns form one session file
    (``session`` = the snippet's ordinal in file-path order); ``one_session`` writes all turns to a
    single file as the original tool did (one writer task).  ``layout="lines"`` writes
    turns as JSON lines instead, as many files as tasks."""
    ensure_checkpoint_dir(spark)
    snip = src.scan_snippets(spark, snippets_path)
    ords = first_appearance_index(snip, "file_path", ["file_path"], "snippet_ord")
    snippets = snip.join(ords, "file_path").select(F.col("snippet_ord").cast("long"), "snippet")
    prompts = src.scan_prompts(spark, prompts_path).select("prompt_ord", "prompt")
    turns = cross_prompts(snippets, prompts)
    session = F.lit("code_snippets") if one_session else F.col("snippet_ord")
    out = turns.select(session.alias("session"), "ord", render_turn(F.col("snippet"), F.col("prompt")).alias("text"))
    sinks.write_session_markdown(out, out_dir, layout=layout)
    return out


def latest_transcripts(spark: SparkSession, transcripts_path: str, model: str | None = None,
                       layout: str = "lines") -> DataFrame:
    """Messages of the latest run per (session, model) below
    ``model=<m>/run_ts=<yyyy-MM-dd_HH-mm>/``, as ``write_chat_json`` writes them.
    ``run_ts`` sorts as text because it is zero-padded.  ``model``: part of a model's
    name; runs of other models are pruned by their folder.

    Which runs are the latest is known before any text is read: from the session
    index (``layout="lines"``), or from the names of the files (``"files"``)."""
    path = transcripts_path.rstrip("/")
    named = F.col("model").cast("string").contains(model) if model is not None else F.lit(True)
    keys = ["session_id", "model", "run_ts"]
    if layout == "lines":
        runs = spark.read.parquet(f"{path}/{sinks.SESSION_INDEX}").where(named)
        latest = materialize(runs.groupBy("session_id", "model").agg(F.max("run_ts").alias("run_ts")), "latest-runs")
        return (src.scan_chat_json(spark, path).where(named)
                .join(checked_broadcast(latest), keys, "left_semi").select(*keys, "idx", "role", "content", "prompt"))
    files = src.list_files(spark, path).where(named)
    latest = files.groupBy("session_id", "model").agg(F.max("run_ts").alias("run_ts"), F.max_by("path", "run_ts").alias("path"))
    return src.parse_chat_json(src.read_chosen(spark, path, latest, tuple(keys)).select(*keys, "text"))


def latest_named_transcripts(spark: SparkSession, transcripts_path: str, model: str | None = None,
                             exclude_test: bool = False) -> DataFrame:
    """Messages of the latest run per (session, model) from a flat folder of
    files named ``<session>_<yyyy-MM-dd>_<HH-mm>_<model>.json`` (the original
    tool's naming, with ``-`` instead of ``:`` in the time: Hadoop paths
    cannot hold a colon).  The latest file per (session, model) is A6, chosen by
    name alone; only those files are read.  ``session_id`` is the session name."""
    names = src.list_files(spark, transcripts_path)
    latest = src.latest_runs(names.select("file_name"), exclude_test=exclude_test)
    if model is not None:
        latest = latest.filter(F.col("model").contains(model))
    latest = materialize(latest.select("file_name", F.col("session").alias("session_id"), "model"), "latest-runs")
    files = src.read_chosen(spark, transcripts_path, names.join(latest, "file_name"))
    return src.parse_chat_json(files.join(checked_broadcast(latest), "file_name").select("session_id", "model", "file_name", "text"))


def metrics_stage(spark: SparkSession, transcripts_path: str, out_path: str, model: str | None = None,
                  include_header: bool = True, distance: str = "levenshtein", fmt: str = "parquet",
                  layout: str = "lines", pairing: str = "row") -> DataFrame:
    """Transcripts -> pairs -> per-pair metrics -> records, written to
    ``out_path``; returns the written table.  ``layout='lines'`` and ``'files'``
    read ``write_chat_json`` output, ``'names'`` a flat folder of
    transcript files named as the original tool named them.  Session ids are
    text.  ``pairing='row'`` takes the first block of a user turn and keeps the
    number of its blocks as ``n_user_blocks``; ``'zip'`` pairs all blocks of a
    session by position, as the published numbers were made."""
    ensure_checkpoint_dir(spark)
    if layout == "names":
        raw = latest_named_transcripts(spark, transcripts_path, model)
    else:
        raw = latest_transcripts(spark, transcripts_path, model, layout)
    msgs = raw.select(F.col("session_id").cast("string").alias("session_id"), F.col("idx").cast("long").alias("idx"),
                      "role", "content", F.coalesce(F.col("prompt"), F.lit("")).alias("prompt"))
    if pairing == "zip":
        records = assemble_records(zip_pairs(msgs), include_header=include_header, distance=distance)
    else:
        pairs = extract_pairs(msgs)
        records = assemble_records(pairs, include_header=include_header, distance=distance, keep=("n_user_blocks",))
    sinks.write_records(records, out_path, fmt=fmt)
    return spark.read.format(fmt).load(out_path) if fmt != "json" else src.scan_records(spark, out_path)


def build_stage(spark: SparkSession, records: DataFrame, outcomes: DataFrame, out_path: str,
                fmt: str = "parquet") -> DataFrame:
    """Records with their build outcome (F2/F3), written to ``out_path``;
    returns the written table.  ``outcomes``: one row per (session_id, idx) with
    ``build_success`` and ``test_success``, or ``exit_code`` and ``log``."""
    ensure_checkpoint_dir(spark)
    if "exit_code" in outcomes.columns:
        outcomes = classify_build_log(outcomes)
    sinks.write_records(attach_build_outcome(records, outcomes), out_path, fmt=fmt)
    return spark.read.format(fmt).load(out_path) if fmt != "json" else src.scan_records(spark, out_path)


def _csv_names(df: DataFrame) -> DataFrame:
    """Report column names as the original CSV files have them."""
    def name(c: str) -> str:
        return c.replace("_per_LOC", "/LOC")
    return df.select([F.col(f"`{c}`").alias(name(c)) for c in df.columns])


def reports_stage(spark: SparkSession, records: DataFrame, out_dir: str, design_size,
                  snippet_count=None, extended: bool = False, labels: dict | None = None) -> dict[str, str]:
    """Records -> report files.  ``design_size``: number of designed snippet
    x prompt combinations (int or one-row DataFrame).  ``snippet_count``: number
    of snippets, the base of the pass rate (default: the largest group).
    ``labels``: prompt id -> label; others keep their text.  ``extended`` also
    writes the per-repository tables (I10-I13), heat-map numbers (I15) and
    multi-bar numbers (I16).  Returns {report: path}."""
    ensure_checkpoint_dir(spark)
    out = out_dir.rstrip("/")
    written: dict[str, str] = {}
    if "session_id" not in records.columns:   # records read from JSON arrays are known by file and position
        records = records.withColumnsRenamed({"file_name": "session_id", "pos": "idx"})
    scored = materialize(rp.score_records(records, snippet_count, labels=labels), "report-input")

    def put(name: str, df: DataFrame, rel: str, order) -> None:
        sinks.write_report_csv(_csv_names(df), f"{out}/{rel}", order_by=order)
        written[name] = f"{out}/{rel}"

    put("summary", rp.describe(records), SUMMARY_FILE, None)
    for key, rel in CATEGORY_FILES.items():
        put(f"category_{key}", rp.category_table(scored, key, design_size), rel, [key])
    mapping = prompt_dictionary(clean_prompts(records))
    sinks.write_prompt_mapping(mapping, f"{out}/{MAPPING_FILE}")
    written["prompt_mapping"] = f"{out}/{MAPPING_FILE}"
    if extended:
        for kind in ("abs", "normalized", "percentage", "factor"):
            put(f"table_{kind}", rp.summary_table(scored, kind), f"table/TABLE_{kind}.csv",
                ["repo_name", "row_kind", "row_label"])
        for element in ("language", "prompt_id"):
            for kind in ("abs", "normalized", "percentage", "factor"):
                put(f"element_{element}_{kind}", rp.element_summary(scored, element, kind),
                    f"table/TABLE_{element}_{kind}.csv", [element, "row_kind", "row_label"])
        put("heatmap", rp.change_matrix(scored), "heatmap/HEATMAP.csv", ["repo_name", "prompt_id"])
        put("multibar", rp.feature_distribution(scored), "multibar/MULTIBAR.csv", ["repo_name", "prompt_id", "ord"])
    return written


def main(argv=None, spark: SparkSession | None = None) -> None:
    """The command line; a session made here is stopped at the end."""
    ap = argparse.ArgumentParser(prog="codeshift.plans.stages")
    sub = ap.add_subparsers(dest="stage", required=True)
    s = sub.add_parser("sessions")
    s.add_argument("snippets")
    s.add_argument("prompts")
    s.add_argument("out")
    s.add_argument("--one-session", action="store_true")
    s.add_argument("--layout", default="files", choices=["files", "lines"])
    m = sub.add_parser("metrics")
    m.add_argument("transcripts")
    m.add_argument("out")
    m.add_argument("--model")
    m.add_argument("--distance", default="levenshtein", choices=["levenshtein", "ndiff"])
    m.add_argument("--layout", default="lines", choices=["lines", "files", "names"])
    m.add_argument("--pairing", default="row", choices=["row", "zip"])
    b = sub.add_parser("build")
    b.add_argument("records")
    b.add_argument("outcomes", help="parquet or JSON lines: session_id, idx and exit_code, log or build_success, test_success")
    b.add_argument("out")
    b.add_argument("--layout", default="parquet", choices=["parquet", "lines", "array"])
    b.add_argument("--outcomes-format", default="parquet", choices=["parquet", "json"])
    b.add_argument("--format", default="parquet", choices=["parquet", "json"])
    r = sub.add_parser("reports")
    r.add_argument("records")
    r.add_argument("out")
    r.add_argument("--design-size", type=int, required=True)
    r.add_argument("--snippet-count", type=int)
    r.add_argument("--layout", default="parquet", choices=["parquet", "lines", "array"])
    r.add_argument("--extended", action="store_true")
    a = ap.parse_args(argv)
    own = spark is None
    if own:
        from ..session import build_session
        spark = build_session()

    def records_in() -> DataFrame:
        if a.layout == "parquet":
            return spark.read.parquet(a.records)
        found = src.scan_records(spark, a.records, layout=a.layout)
        # Records read from JSON arrays are known by file and position.
        return found if "session_id" in found.columns else found.withColumnsRenamed({"file_name": "session_id", "pos": "idx"})

    if a.stage == "sessions":
        sessions_stage(spark, a.snippets, a.prompts, a.out, one_session=a.one_session, layout=a.layout)
    elif a.stage == "metrics":
        metrics_stage(spark, a.transcripts, a.out, model=a.model, distance=a.distance, layout=a.layout, pairing=a.pairing)
    elif a.stage == "build":
        build_stage(spark, records_in(), spark.read.format(a.outcomes_format).load(a.outcomes), a.out, fmt=a.format)
    else:
        print(reports_stage(spark, records_in(), a.out, a.design_size, snippet_count=a.snippet_count, extended=a.extended))
    if own:
        spark.stop()


if __name__ == "__main__":
    main()
