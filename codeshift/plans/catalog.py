"""Registered queries: one per operator of the inventory, each with its DuckDB
oracle statement (absent for the run-based distance, which SQL cannot express).

Every query reads the driver's tables (or files Spark writes from them) and
runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.complexity import complexity_profile, python_complexity
from ..functions.distance import edit_distance, edit_similarity, ndiff_distance, syntactic_similarity
from ..functions.header import header_fields
from ..functions.lines import comment_ratio, line_profile, python_raw_profile
from ..functions.text import escape_whitespace, fenced_blocks, unescape_whitespace
from ..operators import codemetrics as cm
from ..operators import columns as cols
from ..operators import extract as ex
from ..operators import normalize as nz
from ..operators import outcomes as oc
from ..operators import reports as rp
from ..operators import sessions as ss
from ..session import scratch_path
from ..sinks import files as sinks
from ..sources import files as src
from ..sources.tables import build_logs, load_table, stored_responses
from . import oracle as O
from . import records as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


W = O.with_
MSG = O.messages_ctes()
PAIRS = O.pairs_ctes()
HDR = O.pairs_ctes() + O.header_ctes()
REC = O.records_ctes()
SCORED = O.scored_ctes()
SCORED_D = SCORED + [O.design_cte()]
REC_COLS = ", ".join(cm.RECORD_COLUMNS)
M = list(cm.PAIR_METRICS)


# ================================================================ records (flagship)

@register("records", W(REC, f"SELECT {REC_COLS} FROM records"))
def q_records(spark, sf):
    """Stage 2: transcripts -> pairs -> metrics, written once as the records table."""
    return P.records_table(spark, sf)


@register("assemble_records", W(REC, f"SELECT {REC_COLS} FROM records"))
def q_assemble_records(spark, sf):
    """D11 computed lazily from the pairs (no stage table)."""
    return cm.assemble_records(P.pairs(spark, sf), include_header=True, distance="levenshtein", fold=True)


@register("records_stream", W(O.numbered(REC), f"SELECT {REC_COLS} FROM records"))
def q_records_stream(spark, sf):
    """Transcripts written as files (B2), then stage 2 as a Structured
    Streaming query (available-now trigger) into parquet, read back."""
    from ..streaming.transcripts import start_records_stream
    src_dir, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    sinks.write_chat_json(P.messages(spark, sf), src_dir, model="coder-7b-it", run_ts="2024-06-03_17-28", layout="files")
    q = start_records_stream(spark, src_dir, out, fold=True)
    q.awaitTermination()
    r = spark.read.parquet(out)
    return r.withColumn("session_id", F.col("session_id").cast("long")).select(*cm.RECORD_COLUMNS)


@register("records_parity")
def q_records_parity(spark, sf):
    """Published-number mode: run-based distance (E6/E7), header included."""
    return P.records(spark, sf, distance="ndiff", fold=False)


# ================================================================ A: sources

@register("scan_snippets", "SELECT CAST(item_id AS BIGINT) AS item_id, text || chr(10) AS snippet FROM benchmark")
def q_scan_snippets(spark, sf):
    out = scratch_path(spark, "snippets")
    b = load_table(spark, sf, "benchmark")
    b.select("item_id", "text").write.mode("overwrite").partitionBy("item_id").text(out)
    s = src.scan_snippets(spark, out)
    return s.select(F.col("item_id").cast("long").alias("item_id"), "snippet")


PROMPT_LIST_SQL = W(MSG + [
    f"p AS (SELECT DISTINCT {O.clean_prompt('prompt')} AS prompt FROM session_messages WHERE role = 'user')"],
    "SELECT CAST(row_number() OVER (ORDER BY prompt) - 1 AS INTEGER) AS prompt_ord, prompt FROM p")


@register("scan_prompts", PROMPT_LIST_SQL)
def q_scan_prompts(spark, sf):
    """Render the prompt list file from the data, then parse it back (A2)."""
    out = scratch_path(spark, "prompts")
    pl = P.prompt_list(spark, sf)
    entries = F.array_sort(F.collect_list(F.struct("prompt_ord", "prompt")))
    body = F.concat(F.lit("Prompts to test:\n\n"),
                    F.array_join(F.transform(entries, lambda e: F.concat(
                        F.lit("- "), e["prompt"], F.lit("  \n\n"),
                        F.when(e["prompt_ord"] % 2 == 1, F.lit("--------\n\n")).otherwise(F.lit("")))), ""))
    pl.agg(body.alias("value")).coalesce(1).write.mode("overwrite").text(out)
    return src.scan_prompts(spark, out).select(F.col("prompt_ord").cast("int").alias("prompt_ord"), "prompt")


SESSION_MD_SQL = W(MSG + [
    ("u AS (SELECT session_id, idx, " + O.as_code("c.text") + " AS code, 'prompt ' || CAST((session_id + idx) % 8 AS VARCHAR) AS p, "
     "row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY session_id) AS n "
     "FROM session_messages m JOIN conversations c ON c.conv_id = m.session_id AND c.turn = m.idx WHERE m.role = 'user')"),
    ("body AS (SELECT session_id, k, '```' || chr(10) || code || chr(10) || '```' || chr(10) || p || "
     "CASE WHEN k < n THEN chr(10) ELSE '' END AS b, p FROM u)"),
], ("SELECT CAST(session_id AS BIGINT) AS session, CAST(k AS INTEGER) AS idx, 'user' AS role, "
    "replace(b, chr(10), chr(10) || ' ') || chr(10) AS content, p || chr(10) AS prompt FROM body "
    "UNION ALL SELECT DISTINCT CAST(session_id AS BIGINT), 0, 'system', " + O.lit(src.DEFAULT_SYSTEM_PROMPT)
    + ", CAST(NULL AS VARCHAR) FROM u"))


def _session_turns_of(spark, sf) -> DataFrame:
    """Each conversation's user turns, rendered."""
    from ..sources.tables import as_code
    m = P.messages(spark, sf).filter(F.col("role") == "user")
    conv = load_table(spark, sf, "conversations")
    u = m.join(conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"),
                           as_code("text").alias("code")), ["session_id", "idx"])
    return u.select(F.col("session_id").alias("session"), F.col("idx").alias("ord"),
                    ss.render_turn(F.col("code"), F.col("prompt")).alias("text"))


def _session_round_trip(spark, sf, layout: str) -> DataFrame:
    out = scratch_path(spark, f"sessions-{layout}")
    sinks.write_session_markdown(_session_turns_of(spark, sf), out, layout=layout)
    parsed = src.scan_session_markdown(spark, out, layout=layout)
    return parsed.select(F.col("session").cast("long").alias("session"), F.col("idx").cast("int").alias("idx"),
                         "role", "content", "prompt")


@register("parse_session_markdown", SESSION_MD_SQL)
def q_parse_session_markdown(spark, sf):
    """Render each conversation's user turns as session markdown (C2 + B1),
    then parse the files back (A3)."""
    return _session_round_trip(spark, sf, "files")


@register("parse_session_turns", SESSION_MD_SQL)
def q_parse_session_turns(spark, sf):
    """The same over turns written as lines, as many files as tasks."""
    return _session_round_trip(spark, sf, "lines")


TRANSCRIPT_SQL = W(O.numbered(MSG), "SELECT CAST(session_id AS BIGINT) AS session_id, CAST(idx AS BIGINT) AS idx, role, content, prompt FROM session_messages")


def _messages_back(t: DataFrame) -> DataFrame:
    return t.select(F.col("session_id").cast("long").alias("session_id"), F.col("idx").cast("long").alias("idx"),
                    "role", "content", "prompt")


@register("scan_chat_json", TRANSCRIPT_SQL)
def q_scan_chat_json(spark, sf):
    """Write transcripts as message lines (B2), read them back (A4)."""
    out = scratch_path(spark, "chats")
    sinks.write_chat_json(P.messages(spark, sf), out, model="coder-7b-it", run_ts="2024-06-03_17-28")
    return _messages_back(src.scan_chat_json(spark, out))


@register("scan_chat_files", TRANSCRIPT_SQL)
def q_scan_chat_files(spark, sf):
    """Export transcripts as one JSON array per session (B2), read them back (A4)."""
    out = scratch_path(spark, "chat-files")
    sinks.write_chat_json(P.messages(spark, sf), out, model="coder-7b-it", run_ts="2024-06-03_17-28", layout="files")
    return _messages_back(src.scan_chat_json(spark, out, layout="files"))


LATEST_TRANSCRIPTS_SQL = W(O.numbered(MSG), "SELECT CAST(session_id AS BIGINT) AS session_id, 'coder-7b-it' AS model, "
                           "CASE WHEN session_id % 3 = 0 THEN '2024-06-04_09-05' ELSE '2024-06-03_17-28' END AS run_ts, "
                           "CAST(idx AS BIGINT) AS idx, role, "
                           "CASE WHEN session_id % 3 = 0 THEN upper(role) || ' again' ELSE content END AS content FROM session_messages")


def _two_runs(spark, sf, layout: str) -> str:
    """All sessions in a first run, a third of them in a later one, and a run of another model."""
    out, m = scratch_path(spark, f"runs-{layout}"), P.messages(spark, sf)
    sinks.write_chat_json(m, out, model="coder-7b-it", run_ts="2024-06-03_17-28", layout=layout)
    later = m.where(F.col("session_id") % 3 == 0).withColumn("content", F.concat(F.upper("role"), F.lit(" again")))
    sinks.write_chat_json(later, out, model="coder-7b-it", run_ts="2024-06-04_09-05", layout=layout)
    sinks.write_chat_json(later.limit(0), out, model="other", run_ts="2024-07-01_00-00", layout=layout)
    return out


def _latest_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("session_id").cast("long").alias("session_id"), F.col("model").cast("string").alias("model"),
                     F.col("run_ts").cast("string").alias("run_ts"), F.col("idx").cast("long").alias("idx"), "role", "content")


@register("latest_transcripts", LATEST_TRANSCRIPTS_SQL)
def q_latest_transcripts(spark, sf):
    """The latest run of each session of a model named in part (A6), from the session index."""
    from .stages import latest_transcripts
    return _latest_columns(latest_transcripts(spark, _two_runs(spark, sf, "lines"), model="coder"))


@register("latest_transcript_files", LATEST_TRANSCRIPTS_SQL)
def q_latest_transcript_files(spark, sf):
    """The same from exported files, chosen by name before any is read."""
    from .stages import latest_transcripts
    return _latest_columns(latest_transcripts(spark, _two_runs(spark, sf, "files"), model="coder", layout="files"))


@register("write_chat_json", W(MSG, "SELECT CAST(session_id AS BIGINT) AS session_id, 'coder-7b-it' AS model, "
                              "'2024-06-03_17-28' AS run_ts, count(*) AS n_messages FROM session_messages GROUP BY session_id"))
def q_write_chat_json(spark, sf):
    out = scratch_path(spark, "chats2")
    sinks.write_chat_json(P.messages(spark, sf), out, model="coder-7b-it", run_ts="2024-06-03_17-28")
    parsed = src.scan_chat_json(spark, out)
    return (parsed.groupBy(F.col("session_id").cast("long").alias("session_id"),
                           F.col("model").cast("string").alias("model"),
                           F.col("run_ts").cast("string").alias("run_ts"))
            .agg(F.count(F.lit(1)).alias("n_messages")))


@register("scan_records", W(REC, f"SELECT {REC_COLS} FROM records"))
def q_scan_records(spark, sf):
    """Write records as JSON lines (B3), read them back (A5)."""
    out = scratch_path(spark, "records_json")
    sinks.write_records(P.records_table(spark, sf), out, fmt="json")
    r = src.scan_records(spark, out, layout="lines").select(*cm.RECORD_COLUMNS)
    return r.withColumn("session_id", F.col("session_id").cast("long"))


RUN_NAME = ("'code_snippets' || CAST(conv_id % 7 AS VARCHAR) || '_2024-06-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') "
            "|| '_' || lpad(CAST(conv_id % 24 AS VARCHAR), 2, '0') || '-' || lpad(CAST((conv_id * 7) % 60 AS VARCHAR), 2, '0') "
            "|| '_' || CASE conv_id % 3 WHEN 0 THEN 'coder-7b-it' WHEN 1 THEN 'coder-13b-it' ELSE 'other' END || '.json'")

LATEST_SQL = W([
    f"n AS (SELECT DISTINCT {RUN_NAME} AS file_name FROM conversations)",
    ("p AS (SELECT file_name, string_split(file_name, '_') AS parts FROM n)"),
    ("q AS (SELECT file_name, parts[1] || '_' || parts[2] AS session, regexp_replace(parts[5], '\\.json$', '') AS model, "
     "strptime(parts[3] || ' ' || substr(parts[4], 1, length(parts[4]) - 3) || ':' || right(parts[4], 2), '%Y-%m-%d %H:%M') AS run_ts FROM p)"),
    ("r AS (SELECT *, row_number() OVER (PARTITION BY session, model ORDER BY run_ts DESC, file_name) AS rn FROM q)"),
], "SELECT session, model, file_name, strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run_ts FROM r WHERE rn = 1")


def _run_names(spark, sf):
    c = load_table(spark, sf, "conversations").select("conv_id").distinct()
    cid = F.col("conv_id")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    model = (F.when(cid % 3 == 0, F.lit("coder-7b-it")).when(cid % 3 == 1, F.lit("coder-13b-it"))
             .otherwise(F.lit("other")))
    name = F.concat(F.lit("code_snippets"), (cid % 7).cast("string"), F.lit("_2024-06-"), pad(cid % 28 + 1),
                    F.lit("_"), pad(cid % 24), F.lit("-"), pad((cid * 7) % 60), F.lit("_"), model, F.lit(".json"))
    return c.select(name.alias("file_name")).distinct()


@register("latest_run", LATEST_SQL)
def q_latest_run(spark, sf):
    r = src.latest_runs(_run_names(spark, sf))
    return r.withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))


# ================================================================ B: sinks

@register("write_session_markdown", W([
    "t AS (SELECT item_id, p.prompt_ord, p.prompt, b.text FROM benchmark b, "
    "(SELECT CAST(row_number() OVER (ORDER BY prompt) - 1 AS INTEGER) AS prompt_ord, prompt FROM "
    "(SELECT DISTINCT " + O.clean_prompt("'prompt ' || CAST((conv_id + turn) % 8 AS VARCHAR)")
    + " AS prompt FROM conversations WHERE role = 'user')) p)"],
    "SELECT CAST(item_id AS BIGINT) AS session, string_agg(chr(10) || '## User ' || chr(10) || '```' || chr(10) || text || chr(10) "
    "|| '```' || chr(10) || prompt || chr(10), '' ORDER BY prompt_ord) AS text FROM t GROUP BY item_id"))
def q_write_session_markdown(spark, sf):
    """Stage 1 end to end: snippets x prompts rendered (C1, C2), one
    markdown file per snippet session (B1), read back whole."""
    out = scratch_path(spark, "session_md")
    t = P.session_turns(spark, sf).select(F.col("snippet_ord").alias("session"), "ord", "text")
    sinks.write_session_markdown(t, out)
    back = spark.read.text(out, wholetext=True)
    return back.select(F.col("session").cast("long").alias("session"), F.col("value").alias("text"))


@register("write_records", W(REC, f"SELECT {REC_COLS} FROM records"))
def q_write_records(spark, sf):
    out = scratch_path(spark, "records_parquet")
    sinks.write_records(P.records_table(spark, sf), out, fmt="parquet")
    return spark.read.parquet(out).select(*cm.RECORD_COLUMNS)


DICT_SQL = W(SCORED, "SELECT prompt, prompt_ord FROM dict")


@register("write_prompt_mapping", DICT_SQL)
def q_write_prompt_mapping(spark, sf):
    out = scratch_path(spark, "mapping")
    d = cols.prompt_dictionary(ex.clean_prompts(P.records_table(spark, sf)))
    sinks.write_prompt_mapping(d, out)
    back = spark.read.text(out, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.IntegerType()))
    return back.select(F.explode(m).alias("prompt", "prompt_ord"))


CAT_COLS = ("pass_rate, og_LOC, up_LOC, og_comment, up_comment, og_cyclomatic_complexity, "
            "up_cyclomatic_complexity, num_elements")


def _category_sql(key: str) -> str:
    keep = ["LOC", "comment", "cyclomatic_complexity"]
    means = ", ".join(f"round_even(avg({s}_{m}), 1) AS {a}_{m}" for m in keep
                      for s, a in (("original", "og"), ("updated", "up")))
    return W(SCORED_D + [
        f"k AS (SELECT * FROM scored WHERE {key} IS NOT NULL)",
        f"nk AS (SELECT count(DISTINCT {key}) AS nkeys FROM k)"],
        f"SELECT {key}, round_even(count(*) / (max(d.design_size) / max(nk.nkeys)), 1) AS pass_rate, {means}, "
        f"count(*) AS num_elements FROM k CROSS JOIN nk CROSS JOIN design d GROUP BY {key}")


@register("write_report_csv", _category_sql("prompt_id"))
def q_write_report_csv(spark, sf):
    out = scratch_path(spark, "report_csv")
    rep = rp.category_table(P.scored(spark, sf), "prompt_id", P.design_size(spark, sf))
    sinks.write_report_csv(rep, out, order_by=["prompt_id"])
    return spark.read.schema(rep.schema).option("header", True).csv(out)


# ================================================================ C: sessions

@register("cross_prompts", W([
    "p AS (SELECT CAST(row_number() OVER (ORDER BY prompt) - 1 AS INTEGER) AS prompt_ord, prompt FROM "
    "(SELECT DISTINCT " + O.clean_prompt("'prompt ' || CAST((conv_id + turn) % 8 AS VARCHAR)")
    + " AS prompt FROM conversations WHERE role = 'user'))",
    "np AS (SELECT count(*) AS n FROM p)"],
    "SELECT b.item_id AS snippet_ord, b.text AS snippet, p.prompt_ord, p.prompt, "
    "CAST(b.item_id * np.n + p.prompt_ord AS BIGINT) AS ord FROM benchmark b, p, np"))
def q_cross_prompts(spark, sf):
    return ss.cross_prompts(P.snippets(spark, sf), P.prompt_list(spark, sf))


@register("render_turn", W([
    "p AS (SELECT CAST(row_number() OVER (ORDER BY prompt) - 1 AS INTEGER) AS prompt_ord, prompt FROM "
    "(SELECT DISTINCT " + O.clean_prompt("'prompt ' || CAST((conv_id + turn) % 8 AS VARCHAR)")
    + " AS prompt FROM conversations WHERE role = 'user'))"],
    "SELECT b.item_id AS snippet_ord, p.prompt_ord, chr(10) || '## User ' || chr(10) || '```' || chr(10) || b.text || chr(10) "
    "|| '```' || chr(10) || p.prompt || chr(10) AS text FROM benchmark b, p"))
def q_render_turn(spark, sf):
    return P.session_turns(spark, sf).select("snippet_ord", "prompt_ord", "text")


@register("design_size", W(MSG, "SELECT (SELECT count(*) FROM benchmark) AS n_snippets, "
                                 "(SELECT count(DISTINCT prompt) FROM session_messages WHERE role = 'user') AS n_prompts, "
                                 "(SELECT count(*) FROM benchmark) * (SELECT count(DISTINCT prompt) FROM session_messages WHERE role = 'user') AS design_size"))
def q_design_size(spark, sf):
    return ss.design_size(P.snippets(spark, sf), P.prompt_list(spark, sf)).select(
        "n_snippets", "n_prompts", "design_size")


INSTR = "ic AS (SELECT session_id, count(*) AS n FROM session_messages WHERE role <> 'assistant' GROUP BY session_id)"
CUMUL_SQL = ("SELECT u.session_id, u.idx AS request_idx, h.idx AS pos, h.role, h.content FROM session_messages u "
             "JOIN ic USING (session_id) JOIN session_messages h ON h.session_id = u.session_id AND h.idx <= u.idx "
             "WHERE u.role = 'user' AND ic.n <= {hi}")
INDEP_SQL = ("SELECT u.session_id, u.idx AS request_idx, u.idx AS pos, u.role, u.content FROM session_messages u "
             "JOIN ic USING (session_id) WHERE u.role = 'user' AND ic.n > {lo} UNION ALL "
             "SELECT u.session_id, u.idx, s.idx, s.role, s.content FROM session_messages u JOIN ic USING (session_id) "
             "JOIN session_messages s ON s.session_id = u.session_id AND s.role = 'system' WHERE u.role = 'user' AND ic.n > {lo}")


@register("context_cumulative", W(MSG + [INSTR], CUMUL_SQL.format(hi=1000000)))
def q_context_cumulative(spark, sf):
    return ss.context_cumulative(P.messages(spark, sf))


@register("context_independent", W(MSG + [INSTR], INDEP_SQL.format(lo=-1)))
def q_context_independent(spark, sf):
    return ss.context_independent(P.messages(spark, sf))


STORED_SQL = W(MSG, f"SELECT session_id, idx, role, CASE WHEN role = 'user' THEN {O.escape('content')} ELSE content END AS content FROM session_messages")


@register("stored_independent", STORED_SQL)
def q_stored_independent(spark, sf):
    """C5's stored transcript: user contents escaped."""
    return ss.stored_independent(P.messages(spark, sf)).select("session_id", "idx", "role", "content")


@register("build_requests", W(MSG + [INSTR], f"SELECT *, 'cumulative' AS mode FROM ({CUMUL_SQL.format(hi=5)}) "
                                              f"UNION ALL SELECT *, 'independent' FROM ({INDEP_SQL.format(lo=5)})"))
def q_build_requests(spark, sf):
    return ss.build_requests(P.messages(spark, sf))


@register("escape_whitespace", W(MSG, f"SELECT session_id, idx, {O.escape('content')} AS content FROM session_messages"))
def q_escape(spark, sf):
    return P.messages(spark, sf).select("session_id", "idx", escape_whitespace("content").alias("content"))


@register("unescape_whitespace", W(MSG, f"SELECT session_id, idx, {O.unescape(O.escape('content'))} AS content FROM session_messages"))
def q_unescape(spark, sf):
    return P.messages(spark, sf).select("session_id", "idx", unescape_whitespace(escape_whitespace("content")).alias("content"))


@register("parse_completion", W(MSG, "SELECT session_id, idx, 'assistant' AS role, " + O.strip("content")
                                     + " AS content FROM session_messages WHERE role = 'assistant' AND instr(content, '```') > 0"))
def q_parse_completion(spark, sf):
    return ss.parse_completion(stored_responses(P.messages(spark, sf)))


@register("transcript_view", W(MSG, "SELECT session_id, idx, CASE lower(role) WHEN 'assistant' THEN 'Model: ' || content "
                                    "ELSE 'User: ' || content END AS line FROM session_messages WHERE lower(role) IN ('assistant', 'user')"))
def q_transcript_view(spark, sf):
    return ss.transcript_view(P.messages(spark, sf))


# ================================================================ D: extraction

@register("pair_turns", W(MSG + [O.turns_cte()], "SELECT session_id, idx, prompt, user_content, answer_content FROM turns"))
def q_pair_turns(spark, sf):
    return ex.pair_turns(P.messages(spark, sf))


@register("filter_answered", W(MSG + [O.turns_cte()], "SELECT session_id, idx, prompt, user_content, answer_content "
                                                       "FROM turns WHERE instr(answer_content, '```') > 0"))
def q_filter_answered(spark, sf):
    return ex.filter_answered(ex.pair_turns(P.messages(spark, sf)))


@register("extract_fenced_blocks", W(MSG + [O.turns_cte()], (
    "SELECT session_id, idx, 'user' AS side, CAST(b.pos - 1 AS INTEGER) AS pos, b.block FROM turns, "
    f"unnest({O.fenced(O.unescape('user_content'))}) WITH ORDINALITY AS b(block, pos) WHERE instr(answer_content, '```') > 0 "
    "UNION ALL SELECT session_id, idx, 'answer', CAST(b.pos - 1 AS INTEGER), b.block FROM turns, "
    f"unnest({O.fenced('answer_content')}) WITH ORDINALITY AS b(block, pos) WHERE instr(answer_content, '```') > 0")))
def q_extract_fenced_blocks(spark, sf):
    t = ex.filter_answered(ex.pair_turns(P.messages(spark, sf)))
    u = t.select("session_id", "idx", F.lit("user").alias("side"),
                 F.posexplode(ex.user_blocks("user_content")).alias("pos", "block"))
    a = t.select("session_id", "idx", F.lit("answer").alias("side"),
                 F.posexplode(fenced_blocks("answer_content")).alias("pos", "block"))
    return u.unionByName(a)


@register("merge_answer_blocks", W(MSG + [O.turns_cte()], f"SELECT session_id, idx, {O.merged_answer('answer_content')} AS updated_code "
                                                           "FROM turns WHERE instr(answer_content, '```') > 0"))
def q_merge_answer_blocks(spark, sf):
    t = ex.filter_answered(ex.pair_turns(P.messages(spark, sf)))
    return t.select("session_id", "idx", ex.merge_answer_blocks("answer_content").alias("updated_code"))


@register("zip_pairs", W(MSG + [O.turns_cte()] + [
    f"ans AS (SELECT session_id, idx, prompt, {O.merged_answer('answer_content')} AS updated_code, "
    "row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS ord FROM turns WHERE instr(answer_content, '```') > 0)",
    "ub AS (SELECT session_id, b.block AS original_block, row_number() OVER (PARTITION BY session_id ORDER BY idx, b.pos) - 1 AS ord "
    f"FROM turns, unnest({O.fenced(O.unescape('user_content'))}) WITH ORDINALITY AS b(block, pos) WHERE instr(answer_content, '```') > 0)"],
    "SELECT a.session_id, a.idx, a.prompt, u.original_block, a.updated_code, CAST(a.ord AS BIGINT) AS pair_ord "
    "FROM ans a JOIN ub u ON u.session_id = a.session_id AND u.ord = a.ord"))
def q_zip_pairs(spark, sf):
    return ex.zip_pairs(P.messages(spark, sf))


@register("extraction_summary", W(MSG + [
    "t AS (SELECT u.session_id, u.content AS uc, a.content AS ac FROM session_messages u LEFT JOIN session_messages a "
    "ON a.session_id = u.session_id AND a.idx = u.idx + 1 AND a.role = 'assistant' WHERE u.role = 'user')",
    "f AS (SELECT *, coalesce(instr(ac, '```') > 0, false) AS answered FROM t)"],
    f"SELECT session_id, CAST(sum(CASE WHEN answered THEN len({O.fenced(O.unescape('uc'))}) ELSE 0 END) AS BIGINT) AS n_user_blocks, "
    "CAST(count_if(answered) AS BIGINT) AS n_answer_blocks, CAST(count_if(NOT answered) AS BIGINT) AS n_skipped, "
    f"sum(CASE WHEN answered THEN len({O.fenced(O.unescape('uc'))}) ELSE 0 END) <> count_if(answered) AS some_not_rewritten "
    "FROM f GROUP BY session_id"))
def q_extraction_summary(spark, sf):
    return ex.extraction_summary(P.messages(spark, sf))


HDR_COLS = "repo_url, repo_name, path_to_snippet, snippet_func_name, snippet_line_start, snippet_line_end, language, run_command, original_code"


@register("parse_snippet_header", W(HDR, f"SELECT session_id, idx, {HDR_COLS} FROM hdr"))
def q_parse_snippet_header(spark, sf):
    h = header_fields("original_block")
    return P.pairs(spark, sf).select("session_id", "idx", *[h[c].alias(c) for c in HDR_COLS.split(", ")])


@register("snippet_func_name", W(HDR, "SELECT session_id, idx, snippet_func_name FROM hdr"))
def q_snippet_func_name(spark, sf):
    return P.pairs(spark, sf).select("session_id", "idx", header_fields("original_block")["snippet_func_name"].alias("snippet_func_name"))


@register("repo_identity", W(HDR, "SELECT session_id, idx, repo_name, repo_url FROM hdr"))
def q_repo_identity(spark, sf):
    h = header_fields("original_block")
    return P.pairs(spark, sf).select("session_id", "idx", h["repo_name"].alias("repo_name"), h["repo_url"].alias("repo_url"))


@register("run_command", W(HDR, "SELECT session_id, idx, language, run_command FROM hdr"))
def q_run_command(spark, sf):
    h = header_fields("original_block")
    return P.pairs(spark, sf).select("session_id", "idx", h["language"].alias("language"), h["run_command"].alias("run_command"))


@register("clean_prompts", W(MSG, f"SELECT session_id, idx, {O.clean_prompt('prompt')} AS prompt FROM session_messages"))
def q_clean_prompts(spark, sf):
    return ex.clean_prompts(P.messages(spark, sf)).select("session_id", "idx", "prompt")


# ================================================================ E: metrics

DOCS = [f"docs AS (SELECT doc_id, source, lang, {O.as_code('text')} AS code FROM documents)"]
PROFILE_SEL = ("LOC, comment, blank, chars, tokens, CASE WHEN LOC = 0 THEN -1.0 ELSE comment / LOC END AS comment_per_LOC")


@register("classify_lines", W(DOCS + O.profile_ctes("lp", "docs", ["doc_id"], "code")[:4],
                              "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, cls AS line_class, "
                              "CAST(CASE WHEN cls = 'loc' THEN length(s) ELSE 0 END AS INTEGER) AS chars FROM lp_k"))
def q_classify_lines(spark, sf):
    return cm.classify_lines(P.documents_code(spark, sf), ["doc_id"], "code").select("doc_id", "pos", "line_class", "chars")


@register("line_profile", W(DOCS + O.profile_ctes("lp", "docs", ["doc_id"], "code"), f"SELECT doc_id, {PROFILE_SEL} FROM lp"))
def q_line_profile(spark, sf):
    p = line_profile("code")
    return P.documents_code(spark, sf).select("doc_id", *[p[f].alias(f) for f in cm.PROFILE_FIELDS])


@register("comment_ratio", W(PAIRS + O.profile_ctes("lp", "pairs", ["session_id", "idx"], "updated_code"),
                             "SELECT session_id, idx, CASE WHEN LOC = 0 THEN -1.0 ELSE comment / LOC END AS comment_per_LOC FROM lp"))
def q_comment_ratio(spark, sf):
    p = line_profile("updated_code")
    return P.pairs(spark, sf).select("session_id", "idx", comment_ratio(p["comment"], p["LOC"]).alias("comment_per_LOC"))


DIST = f"CAST(levenshtein({O.one_byte('original_block')}, {O.one_byte('updated_code')}) AS BIGINT)"


@register("edit_distance", W(PAIRS, f"SELECT session_id, idx, {DIST} AS distance FROM pairs"))
def q_edit_distance(spark, sf):
    return P.pairs(spark, sf).select("session_id", "idx",
                                     edit_distance("original_block", "updated_code", fold=True).cast("long").alias("distance"))


@register("edit_similarity", W(PAIRS, f"SELECT session_id, idx, 1.0 - CAST({DIST} AS DOUBLE) / "
                                      "nullif(greatest(length(original_block), length(updated_code)), 0) AS similarity FROM pairs"))
def q_edit_similarity(spark, sf):
    d = edit_distance("original_block", "updated_code", fold=True)
    return P.pairs(spark, sf).select("session_id", "idx",
                                     edit_similarity("original_block", "updated_code", distance=d).alias("similarity"))


@register("ndiff_distance")
def q_ndiff_distance(spark, sf):
    return P.pairs(spark, sf).select("session_id", "idx",
                                     ndiff_distance("original_block", "updated_code").alias("distance"))


@register("syntactic_similarity")
def q_syntactic_similarity(spark, sf):
    p = P.pairs(spark, sf).withColumn("_d", ndiff_distance("original_block", "updated_code"))
    return p.select("session_id", "idx", syntactic_similarity("original_block", "updated_code",
                                                              distance=F.col("_d")).alias("similarity"))


@register("ndiff_properties", W(PAIRS, "SELECT session_id, idx, true AS at_least_edit_distance, true AS zero_when_equal_only, "
                                       "true AS at_most_both_lengths, true AS similarity_follows FROM pairs"))
def q_ndiff_properties(spark, sf):
    """What holds for E6/E7 of every pair (their values are beyond SQL)."""
    a, b = F.col("original_block"), F.col("updated_code")
    p = P.pairs(spark, sf).select("session_id", "idx", a, b, ndiff_distance(a, b).alias("d"), edit_distance(a, b).alias("e"))
    longest = F.greatest(F.length(a), F.length(b))
    s = syntactic_similarity("original_block", "updated_code", distance=F.col("d"))
    return p.select("session_id", "idx", (F.col("d") >= F.col("e")).alias("at_least_edit_distance"),
                    ((F.col("d") == 0) == (a == b)).alias("zero_when_equal_only"),
                    (F.col("d") <= F.length(a) + F.length(b)).alias("at_most_both_lengths"),
                    s.eqNullSafe(F.lit(1.0) - F.try_divide(F.col("d").cast("double"), longest.cast("double"))).alias("similarity_follows"))


KNOWN_PAIRS = ["k AS (SELECT conv_id, turn, text AS a, (conv_id + turn) % 4 AS kind, turn % 5 + 1 AS n FROM conversations)"]


@register("ndiff_known_pairs", W(KNOWN_PAIRS, "SELECT conv_id, turn, CAST(CASE kind WHEN 2 THEN 0 WHEN 3 THEN greatest(length(a), n) ELSE n END AS BIGINT) AS distance, "
                                 "CASE WHEN kind = 2 AND a = '' THEN NULL WHEN kind = 2 THEN 1.0::DOUBLE WHEN kind = 3 THEN 0.0::DOUBLE "
                                 "ELSE 1.0::DOUBLE - n::DOUBLE / (length(a) + n) END AS similarity FROM k"))
def q_ndiff_known_pairs(spark, sf):
    """E6/E7 where the diff is known: a run of a character that the text lacks comes
    after it, before it or in its place, or nothing changes."""
    c = load_table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    run = F.repeat(F.lit("\ue000"), (F.col("turn") % 5 + 1).cast("int"))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    b = F.when(kind == 0, F.concat("a", run)).when(kind == 1, F.concat(run, "a")).when(kind == 2, F.col("a")).otherwise(run)
    d = cm.dealt_by_cost(c.withColumn("b", b), "a", "b").withColumn("distance", ndiff_distance("a", "b"))
    return d.select("conv_id", "turn", "distance", syntactic_similarity("a", "b", distance=F.col("distance")).alias("similarity"))


@register("cyclomatic_complexity", W(DOCS, f"SELECT doc_id, {O.decision_points('code')} AS decision_points, "
                                           f"{O.complexity('code')} AS complexity FROM docs"))
def q_cyclomatic_complexity(spark, sf):
    return P.documents_code(spark, sf).select("doc_id", complexity_profile("code").alias("_p")).select("doc_id", "_p.*")


PAIR_METRIC_COLS = [f"{s}_{m}" for s in ("original", "updated") for m in
                    ("LOC", "comment", "blank", "chars", "tokens", "comment_per_LOC", "levenshtein_distance", "syntactic_similarity")]


@register("pair_metrics", W(REC, "SELECT session_id, idx, " + ", ".join(PAIR_METRIC_COLS) + " FROM records"))
def q_pair_metrics(spark, sf):
    p = P.pairs(spark, sf)
    return cm.pair_metrics(p, fold=True).select("session_id", "idx", *PAIR_METRIC_COLS)


@register("metrics_diff", W(REC, " UNION ALL ".join(
    f"SELECT session_id, idx, '{m}' AS metric, CAST(original_{m} AS DOUBLE) AS original, CAST(updated_{m} AS DOUBLE) AS updated "
    f"FROM records WHERE original_{m} IS DISTINCT FROM updated_{m}" for m in cm.PROFILE_FIELDS)))
def q_metrics_diff(spark, sf):
    return cm.metrics_diff(P.records_table(spark, sf))


@register("combine_metrics", W(REC, "SELECT session_id, idx, original_cyclomatic_complexity, updated_cyclomatic_complexity, "
                                    "original_comment_per_LOC, updated_comment_per_LOC FROM records"))
def q_combine_metrics(spark, sf):
    return P.records_table(spark, sf).select("session_id", "idx", "original_cyclomatic_complexity", "updated_cyclomatic_complexity",
                                       "original_comment_per_LOC", "updated_comment_per_LOC")


PY_DOCS = [f"pd AS (SELECT doc_id, replace({O.as_code('text')}, '//', '#') AS code FROM documents)",
           f"pl AS (SELECT doc_id, {O.strip('u.line')} AS s FROM pd, unnest(string_split(code, chr(10))) AS u(line))"]


@register("python_raw_profile", W(PY_DOCS, "SELECT doc_id, CAST(count(*) AS INTEGER) AS loc, "
                                           "CAST(count(*) - count_if(s = '') - count_if(starts_with(s, '#')) AS INTEGER) AS sloc, "
                                           f"CAST(count_if(contains(regexp_replace(s, {O.lit(O.SQL_STRINGS)}, '', 'g'), '#')) AS INTEGER) AS comments, CAST(count_if(s = '') AS INTEGER) AS blank "
                                           "FROM pl GROUP BY doc_id"))
def q_python_raw_profile(spark, sf):
    d = P.documents_code(spark, sf).select("doc_id", F.replace(F.col("code"), F.lit("//"), F.lit("#")).alias("code"))
    p = python_raw_profile("code")
    return d.select("doc_id", *[p[f].alias(f) for f in ("loc", "sloc", "comments", "blank")])


@register("python_complexity", f"SELECT doc_id, {O.complexity('code', 'python')} AS complexity "
                               f"FROM (SELECT doc_id, {O.as_python('text')} AS code FROM documents)")
def q_python_complexity(spark, sf):
    from ..sources.tables import as_python, spread
    d = spread(load_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", python_complexity(as_python("text")).alias("complexity"))


# ================================================================ F: outcomes

# Every file is there in two repositories, under one path and with two texts.
FILES_SQL = [f"files AS (SELECT 'repo' || CAST(doc_id % 6 AS VARCHAR) AS repo_name, 'src/file' || CAST(doc_id AS VARCHAR) || '.cs' AS path, "
             f"{O.as_code('text')} AS text FROM documents UNION ALL SELECT 'repo' || CAST((doc_id + 1) % 6 AS VARCHAR), "
             "'src/file' || CAST(doc_id AS VARCHAR) || '.cs', text FROM documents)"]


@register("splice_lines", W(REC + FILES_SQL + [
    "j AS (SELECT r.session_id, r.idx, f.repo_name, f.path, string_split(f.text, chr(10)) AS L, "
    "CASE WHEN r.updated_code = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(regexp_replace(r.updated_code, "
    "'\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n\\z', ''), chr(10)) END AS U, "
    "greatest(r.snippet_line_start, 0) AS st, r.snippet_line_end AS en, r.snippet_line_start IS NOT NULL AND r.snippet_line_end IS NOT NULL AS ok, f.text "
    "FROM records r JOIN files f ON f.path = r.path_to_snippet AND f.repo_name = r.repo_name)"],
    "SELECT session_id, idx, repo_name, path, CASE WHEN ok THEN array_to_string(list_concat(list_concat(L[1:st], U), "
    "L[greatest(st, en + 1) + 1:]), chr(10)) ELSE text END AS spliced_text FROM j"))
def q_splice_lines(spark, sf):
    from ..sources.tables import as_code
    docs = load_table(spark, sf, "documents")
    path = F.concat(F.lit("src/file"), F.col("doc_id").cast("string"), F.lit(".cs")).alias("path")
    repo = lambda shift: F.concat(F.lit("repo"), ((F.col("doc_id") + shift) % 6).cast("string")).alias("repo_name")
    files = docs.select(repo(0), path, as_code("text").alias("text")).unionByName(docs.select(repo(1), path, "text"))
    return oc.splice_lines(files, P.records_table(spark, sf))


OUTCOME_SQL = MSG + [
    "outc AS (SELECT u.session_id, u.idx, CAST(CASE WHEN (coalesce(l.toxic, 0) + u.idx) % 3 = 0 THEN 0 "
    "WHEN l.quality = 1 THEN 1 END AS INTEGER) AS build_success, '' AS test_success "
    "FROM session_messages u JOIN labels l ON l.doc_id = u.session_id WHERE u.role = 'user')"]
OUTCOME_ONLY = OUTCOME_SQL[-1:]


def _outcomes(spark, sf):
    return oc.classify_build_log(build_logs(load_table(spark, sf, "labels"), P.messages(spark, sf)))


@register("classify_build_log", W(OUTCOME_SQL, "SELECT * FROM outc"))
def q_classify_build_log(spark, sf):
    return _outcomes(spark, sf)


@register("attach_build_outcome", W(REC + OUTCOME_ONLY, "SELECT r.session_id, r.idx, r.repo_name, o.build_success, o.test_success "
                                                        "FROM records r LEFT JOIN outc o USING (session_id, idx)"))
def q_attach_build_outcome(spark, sf):
    return oc.attach_build_outcome(P.records_table(spark, sf), _outcomes(spark, sf)).select(
        "session_id", "idx", "repo_name", "build_success", "test_success")


@register("build_summary", W(REC + OUTCOME_ONLY, "SELECT r.language, CAST(count_if(o.build_success = 1) AS BIGINT) AS builds_succeeded, "
                                                 "CAST(count_if(o.build_success = 0) AS BIGINT) AS builds_failed, "
                                                 "CAST(count_if(o.build_success IS NULL) AS BIGINT) AS builds_unknown "
                                                 "FROM records r LEFT JOIN outc o USING (session_id, idx) GROUP BY r.language"))
def q_build_summary(spark, sf):
    return oc.build_summary(oc.attach_build_outcome(P.records_table(spark, sf), _outcomes(spark, sf)), by="language")


@register("build_stage", W(REC + OUTCOME_ONLY, "SELECT r.session_id, r.idx, r.repo_name, r.updated_LOC, o.build_success, o.test_success "
                                               "FROM records r LEFT JOIN outc o USING (session_id, idx)"))
def q_build_stage(spark, sf):
    """Outcomes attached to the records, written as JSON lines and read back."""
    from .stages import build_stage
    got = build_stage(spark, P.records_table(spark, sf), _outcomes(spark, sf), scratch_path(spark, "records_built"), fmt="json")
    return got.select(F.col("session_id").cast("long").alias("session_id"), "idx", "repo_name", "updated_LOC", "build_success", "test_success")


# ================================================================ G: columns

@register("encode_prompts", DICT_SQL)
def q_encode_prompts(spark, sf):
    d = cols.prompt_dictionary(ex.clean_prompts(P.records_table(spark, sf)))
    return d.select("prompt", F.col("prompt_ord").cast("int").alias("prompt_ord"))


@register("label_prompts", W(SCORED, "SELECT session_id, idx, prompt_ord, prompt_id FROM lab"))
def q_label_prompts(spark, sf):
    r = ex.clean_prompts(P.records_table(spark, sf))
    return cols.label_prompts(cols.encode_prompts(r)).select(
        "session_id", "idx", F.col("prompt_ord").cast("int").alias("prompt_ord"), "prompt_id")


PARTIAL_LABELS = {k: v for k, v in cols.PROMPT_LABELS.items() if k != 7}
PARTIAL_SQL = " ".join(f"WHEN {k} THEN {O.lit(v)}" for k, v in enumerate(O.SQL_LABELS[:7]))


@register("label_prompts_partial", W(SCORED, f"SELECT session_id, idx, prompt_ord, CASE prompt_ord {PARTIAL_SQL} END AS prompt_id FROM lab"))
def q_label_prompts_partial(spark, sf):
    """G2 with id 7 left out of the label map (FIXTURES): ids without a label give NULL."""
    r = ex.clean_prompts(P.records_table(spark, sf))
    return cols.label_prompts(cols.encode_prompts(r), labels=PARTIAL_LABELS).select(
        "session_id", "idx", F.col("prompt_ord").cast("int").alias("prompt_ord"), "prompt_id")


@register("drop_columns_with", W(REC, "SELECT COLUMNS(lambda c: NOT (c LIKE '%code%' OR c LIKE '%distance%')) FROM records"))
def q_drop_columns_with(spark, sf):
    return cols.drop_columns_with(P.records_table(spark, sf), ["code", "distance"])


@register("keep_columns_with", W(REC, "SELECT COLUMNS(lambda c: c LIKE '%LOC%' OR c LIKE '%comment%' OR c IN ('session_id', 'idx')) FROM records"))
def q_keep_columns_with(spark, sf):
    return cols.keep_columns_with(P.records_table(spark, sf), ["LOC", "comment", "session_id", "idx"])


@register("pair_columns", W(REC, f"SELECT {REC_COLS} FROM records"))
def q_pair_columns(spark, sf):
    return cols.pair_columns(P.records_table(spark, sf))


def _describe_name(c: str) -> str:
    s = c.replace("original", "og").replace("updated", "up").replace("comment", "cmnt")
    return cols.DESCRIBE_RENAMES.get(s, s)


SHORT_COLS = [c for c in cm.metric_columns() if c not in ("updated_levenshtein_distance", "updated_syntactic_similarity")]


@register("shorten_names", W(REC, "SELECT session_id, idx, " + ", ".join(f"{c} AS {_describe_name(c)}" for c in SHORT_COLS) + " FROM records"))
def q_shorten_names(spark, sf):
    r = P.records_table(spark, sf).select("session_id", "idx", *cm.metric_columns())
    return cols.shorten_names(r, style="describe")


@register("numeric_columns", W(REC, "SELECT session_id, idx, " + ", ".join(cm.metric_columns()) + " FROM records"))
def q_numeric_columns(spark, sf):
    r = P.records_table(spark, sf)
    return r.select("session_id", "idx", *cols.numeric_columns(r))


@register("first_column", W(SCORED, "SELECT pass_rate, session_id, idx, repo_name, prompt_id FROM scored"))
def q_first_column(spark, sf):
    return cols.first_column(P.scored(spark, sf).select("session_id", "idx", "repo_name", "prompt_id", "pass_rate"))


# ================================================================ H: normalisation

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _norm_sql(method: str) -> str:
    if method == "zscore":
        stats = ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS b_{c}" for c in LI_COLS)
        expr = {c: f"({c} - a_{c}) / nullif(b_{c}, 0)" for c in LI_COLS}
    else:
        stats = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in LI_COLS)
        expr = {c: f"({c} - a_{c}) / nullif(b_{c} - a_{c}, 0)" for c in LI_COLS}
    ok = " AND ".join(f"({expr[c]}) IS NOT NULL AND NOT isnan({expr[c]})" for c in LI_COLS)
    sel = ", ".join(f"CASE WHEN {ok} THEN CAST(CAST(trunc(round_even({expr[c]}, 1)) AS BIGINT) AS DOUBLE) ELSE CAST({c} AS DOUBLE) END AS {c}"
                    for c in LI_COLS)
    return W([f"s AS (SELECT {stats} FROM lineitem)"],
             f"SELECT l_orderkey, l_linenumber, l_returnflag, {sel} FROM lineitem CROSS JOIN s")


def _lineitem(spark, sf):
    return load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *LI_COLS)


@register("zscore_normalize", _norm_sql("zscore"))
def q_zscore(spark, sf):
    return nz.zscore_normalize(_lineitem(spark, sf), columns=LI_COLS)


@register("minmax_normalize", _norm_sql("minmax"))
def q_minmax(spark, sf):
    return nz.minmax_normalize(_lineitem(spark, sf), columns=LI_COLS)


def _keyed_minmax_sql() -> str:
    stats = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in LI_COLS)
    expr = {c: f"({c} - a_{c}) / nullif(b_{c} - a_{c}, 0)" for c in LI_COLS}
    ok = " AND ".join(f"({expr[c]}) IS NOT NULL AND NOT isnan({expr[c]})" for c in LI_COLS)
    sel = ", ".join(f"CASE WHEN {ok} THEN {expr[c]} ELSE CAST({c} AS DOUBLE) END AS {c}" for c in LI_COLS)
    return W([f"s AS (SELECT l_returnflag, {stats} FROM lineitem GROUP BY l_returnflag)"],
             f"SELECT l_orderkey, l_linenumber, l_returnflag, {sel} FROM lineitem JOIN s USING (l_returnflag)")


@register("minmax_normalize_by_key", _keyed_minmax_sql())
def q_minmax_by_key(spark, sf):
    """H2 per key (the per-repository form used by I13), untruncated."""
    return nz.minmax_normalize(_lineitem(spark, sf), columns=LI_COLS, partition_by="l_returnflag", truncate=False)


# ================================================================ I: reports

STAT_COLS = [f"{c}_{s}" for c in cm.metric_columns() for s in ("min", "max", "mean")]


@register("add_group_stats", W(SCORED, "SELECT session_id, idx, repo_name, " + ", ".join(STAT_COLS) + " FROM scored"))
def q_add_group_stats(spark, sf):
    return P.scored(spark, sf).select("session_id", "idx", "repo_name", *STAT_COLS)


@register("add_pass_rate", W(SCORED, "SELECT session_id, idx, repo_name, prompt_id, pass_rate FROM scored"))
def q_add_pass_rate(spark, sf):
    return P.scored(spark, sf).select("session_id", "idx", "repo_name", "prompt_id", "pass_rate")


@register("rescale_pass_rate", W(SCORED, "SELECT session_id, idx, pass_rate * (SELECT count(DISTINCT prompt_id) FROM scored) AS pass_rate FROM scored"))
def q_rescale_pass_rate(spark, sf):
    return rp.rescale_pass_rate(P.scored(spark, sf), "prompt_id").select("session_id", "idx", "pass_rate")


def _describe_sql() -> str:
    names = [(c, _describe_name(c)) for c in cm.metric_columns() if c not in ("updated_levenshtein_distance", "updated_syntactic_similarity")]
    base = "b AS (SELECT " + ", ".join(f"round_even(CAST({c} AS DOUBLE), 1) AS {n}" for c, n in names) + " FROM records)"
    stats = [("count", "CAST(count({n}) AS DOUBLE)"), ("mean", "avg({n})"), ("std", "stddev_samp({n})"), ("min", "min({n})"),
             ("25%", "quantile_cont({n}, 0.25)"), ("50%", "quantile_cont({n}, 0.5)"), ("75%", "quantile_cont({n}, 0.75)"),
             ("max", "max({n})")]
    sel = " UNION ALL ".join(
        f"SELECT '{s}' AS statistic, " + ", ".join(f"round_even({e.format(n=n)}, 1) AS \"{n}\"" for _, n in names) + " FROM b"
        for s, e in stats)
    return W(REC + [base], sel)


@register("describe", _describe_sql())
def q_describe(spark, sf):
    return rp.describe(P.records_table(spark, sf))


for _key, _suffix in (("prompt_id", "prompt"), ("language", "language"), ("repo_name", "repo")):
    def _mk_cat(key):
        return lambda spark, sf: rp.category_table(P.scored(spark, sf), key, P.design_size(spark, sf))
    register(f"category_table_{_suffix}", _category_sql(_key))(_mk_cat(_key))


@register("category_table", _category_sql("prompt_id"))
def q_category_table(spark, sf):
    """I5 under its inventory name: the per-prompt table (the reference's first category)."""
    return rp.category_table(P.scored(spark, sf), "prompt_id", P.design_size(spark, sf))


@register("category_counts", W(SCORED, "SELECT language, CAST(count(*) AS BIGINT) AS num_elements, false AS is_total FROM scored "
                                       "WHERE language IS NOT NULL GROUP BY language UNION ALL "
                                       "SELECT NULL, CAST(count(*) AS BIGINT), true FROM scored WHERE language IS NOT NULL"))
def q_category_counts(spark, sf):
    return rp.category_counts(P.scored(spark, sf), "language")


def _pct_sql(key: str) -> str:
    pairs = [("LOC", "LOC"), ("comment", "comment"), ("blank", "blank"), ("chars", "chars"), ("tokens", "tokens"),
             ("levenshtein_distance", "edit_dist"), ("syntactic_similarity", "syn_simi"), ("cyclomatic_complexity", "cyclo")]
    rows = ", ".join(f"(updated_{m} - original_{m}) / nullif(CAST(original_{m} AS DOUBLE), 0) * 100 AS {a}" for m, a in pairs)
    means = ", ".join(f"round_even(avg({a}), 1) AS {a}" for _, a in pairs)
    return W(SCORED_D + [
        f"k AS (SELECT * FROM scored WHERE {key} IS NOT NULL)",
        f"nk AS (SELECT count(DISTINCT {key}) AS nkeys FROM k)",
        f"c AS (SELECT {key}, count(*) AS n FROM k GROUP BY {key})",
        f"r AS (SELECT k.{key}, c.n / (d.design_size / nk.nkeys) * 100 AS pass_rate, {rows} FROM k JOIN c USING ({key}) CROSS JOIN nk CROSS JOIN design d)"],
        f"SELECT {key}, round_even(avg(pass_rate), 1) AS pass_rate, {means} FROM r GROUP BY {key}")


for _key, _suffix in (("prompt_id", "prompt"), ("language", "language"), ("repo_name", "repo")):
    def _mk_pct(key):
        return lambda spark, sf: rp.category_pct_change(P.scored(spark, sf), key, P.design_size(spark, sf))
    register(f"category_pct_change_{_suffix}", _pct_sql(_key))(_mk_pct(_key))


@register("category_pct_change", _pct_sql("prompt_id"))
def q_category_pct_change(spark, sf):
    """I7 under its inventory name: per prompt."""
    return rp.category_pct_change(P.scored(spark, sf), "prompt_id", P.design_size(spark, sf))


BASE_COLS = ["pass_rate"] + M
B8_SQL = W(SCORED + [
    "f AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY session_id, idx) AS rn FROM scored WHERE pass_rate = 100)"],
    "SELECT repo_name, " + ", ".join(
        (f"CAST(NULL AS DOUBLE) AS {m}" if m in rp.NULL_IN_BASELINE else f"CAST(original_{m} AS DOUBLE) AS {m}") for m in BASE_COLS)
    + " FROM f WHERE rn = 1")


@register("baseline_row", B8_SQL)
def q_baseline_row(spark, sf):
    return rp.baseline_row(P.scored(spark, sf), "repo_name")


def _b9_ctes(src: str, part: str, digits=None) -> list[str]:
    rd = (lambda x: f"round_even({x}, {digits})") if digits is not None else (lambda x: x)
    avgs = ", ".join((f"CAST(NULL AS DOUBLE) AS {m}" if m in rp.NULL_IN_BASELINE else
                      ("CAST(-1 AS DOUBLE) AS cyclomatic_complexity" if m == "cyclomatic_complexity" else
                       (rd(f"avg(CASE WHEN LOC = 0 THEN -1.0 ELSE comment / LOC END)") + " AS comment_per_LOC"
                        if m == "comment_per_LOC" else rd(f"avg(CAST({m} AS DOUBLE))") + f" AS {m}")))
                     for m in BASE_COLS)
    return ([f"dc AS (SELECT DISTINCT {part}, original_code, dense_rank() OVER (ORDER BY {part}, original_code) AS code_id FROM {src})"]
            + O.profile_ctes("dcp", "dc", [part, "code_id"], "original_code")
            + [f"b9 AS (SELECT {part}, {avgs} FROM dcp GROUP BY {part})"])


@register("baseline_from_distinct", W(SCORED + _b9_ctes("scored", "repo_name", digits=6), "SELECT * FROM b9"))
def q_baseline_from_distinct(spark, sf):
    return rp.baseline_from_distinct(P.scored(spark, sf), "repo_name", digits=6)


H2_COLS = list(cm.metric_columns()) + STAT_COLS


def _table_sql(kind: str) -> str:
    """I10/I11/I12 per repo; I13 normalises per repo first.  (The statistics
    columns are constant within a repo, so the row guard keeps raw values.)"""
    ctes = SCORED + [
        "sr AS (SELECT * REPLACE (pass_rate * (SELECT count(DISTINCT prompt_id) FROM scored) AS pass_rate) FROM scored WHERE repo_name IS NOT NULL)"]
    ctes += O.minmax_ctes("sr", "sc", H2_COLS, "repo_name") if kind == "normalized" else ["sc AS (SELECT * FROM sr)"]
    ctes += [c.replace("FROM scored", "FROM sc") for c in [
        "f AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY session_id, idx) AS rn FROM scored WHERE pass_rate = 100)"]]
    ctes += ["b8 AS (SELECT repo_name, " + ", ".join(
        (f"CAST(NULL AS DOUBLE) AS {m}" if m in rp.NULL_IN_BASELINE else f"round_even(CAST(original_{m} AS DOUBLE), 6) AS {m}")
        for m in BASE_COLS) + " FROM f WHERE rn = 1)"]
    ctes += _b9_ctes("sc", "repo_name", digits=6)
    ctes += ["base AS (SELECT b9.repo_name, " + ", ".join(
        f"CASE WHEN b8.repo_name IS NOT NULL THEN b8.{m} ELSE b9.{m} END AS {m}" for m in BASE_COLS)
        + " FROM b9 LEFT JOIN b8 USING (repo_name))"]
    if kind in ("abs", "normalized"):
        grp = ", ".join(f"round_even(avg(CAST(updated_{m} AS DOUBLE)), 1) AS {m}" for m in M)
        ctes += [f"g AS (SELECT repo_name, prompt_id, round_even(avg(pass_rate), 1) AS pass_rate, {grp} FROM sc "
                 "WHERE prompt_id IS NOT NULL GROUP BY repo_name, prompt_id)"]
    else:
        if kind == "percentage":
            f = lambda m: f"round_even((avg(CAST(updated_{m} AS DOUBLE)) - avg(CAST(original_{m} AS DOUBLE))) / nullif(avg(CAST(original_{m} AS DOUBLE)), 0) * 100, 1)"
        else:
            f = lambda m: f"round_even(avg(CAST(updated_{m} AS DOUBLE)) / nullif(avg(CAST(original_{m} AS DOUBLE)), 0) * 100, 1)"
        grp = ", ".join(f"{f(m)} AS {m}" for m in M)
        ctes += [f"g AS (SELECT repo_name, prompt_id, {O.mean('pass_rate')} AS pass_rate, {grp} FROM sc "
                 "WHERE prompt_id IS NOT NULL GROUP BY repo_name, prompt_id)"]
    colsql = ", ".join(BASE_COLS)
    return W(ctes, f"SELECT repo_name, 'Original' AS row_label, 0 AS row_kind, {colsql} FROM base UNION ALL "
                   f"SELECT repo_name, prompt_id, 1, {colsql} FROM g")


@register("prompt_table_abs", _table_sql("abs"))
def q_prompt_table_abs(spark, sf):
    return rp.prompt_table_abs(P.scored(spark, sf), baseline_digits=6)


@register("prompt_table_pct", _table_sql("percentage"))
def q_prompt_table_pct(spark, sf):
    return rp.prompt_table_pct(P.scored(spark, sf), baseline_digits=6)


@register("prompt_table_factor", _table_sql("factor"))
def q_prompt_table_factor(spark, sf):
    return rp.prompt_table_factor(P.scored(spark, sf), baseline_digits=6)


@register("prompt_table_normalized", _table_sql("normalized"))
def q_prompt_table_normalized(spark, sf):
    return rp.prompt_table_normalized(P.scored(spark, sf), baseline_digits=6)


def _element_sql(kind: str, key: str = "language") -> str:
    """Rescale, normalise over all rows (guard columns included), then
    skip; ``normalized`` normalises once more per element."""
    ctes = SCORED + [
        f"sr AS (SELECT * REPLACE (pass_rate * (SELECT count(DISTINCT {key}) FROM scored) AS pass_rate) FROM scored "
        f"WHERE {key} IS NOT NULL)", *O.minmax_ctes("sr", "sn", H2_COLS),
        f"sk AS (SELECT * FROM sn WHERE NOT contains({key}, '// c++'))"]
    ctes += O.minmax_ctes("sk", "sc", H2_COLS, key) if kind == "normalized" else ["sc AS (SELECT * FROM sk)"]
    ctes += [
        f"f AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY session_id, idx) AS rn FROM sc WHERE pass_rate = 100)",
        f"b8 AS (SELECT {key}, " + ", ".join(
            (f"CAST(NULL AS DOUBLE) AS {m}" if m in rp.NULL_IN_BASELINE else f"round_even(CAST(original_{m} AS DOUBLE), 1) AS {m}")
            for m in BASE_COLS) + " FROM f WHERE rn = 1)"]
    ctes += _b9_ctes("sc", key, digits=1)
    ctes += [f"base AS (SELECT b9.{key}, " + ", ".join(
        f"CASE WHEN b8.{key} IS NOT NULL THEN b8.{m} ELSE b9.{m} END AS {m}" for m in BASE_COLS)
        + f" FROM b9 LEFT JOIN b8 USING ({key}))"]
    if kind in ("abs", "normalized"):
        grp = ", ".join(f"round_even(avg(CAST(updated_{m} AS DOUBLE)), 1) AS {m}" for m in M)
        ctes += [f"g AS (SELECT {key}, round_even(avg(pass_rate), 1) AS pass_rate, {grp} FROM sc GROUP BY {key})"]
    else:
        up = {m: f"avg(CAST(updated_{m} AS DOUBLE))" for m in M}
        og = {m: f"avg(CAST(original_{m} AS DOUBLE))" for m in M}
        grp = ", ".join(f"round_even(({up[m]}{f' - {og[m]}' if kind == 'percentage' else ''}) / nullif({og[m]}, 0) * 100, 1) AS {m}"
                        for m in M)
        tenths = "CAST(round_even(round_even(pass_rate, 1) * 10, 0) AS BIGINT)"
        ctes += [f"g AS (SELECT {key}, (sum({tenths}) / nullif(count({tenths}), 0)) / 10 AS pass_rate, {grp} "
                 f"FROM sc GROUP BY {key})"]
    colsql = ", ".join(BASE_COLS)
    return W(ctes, f"SELECT {key}, 'Original' AS row_label, 0 AS row_kind, {colsql} FROM base UNION ALL "
                   f"SELECT {key}, {key}, 1, {colsql} FROM g")


@register("element_summary", _element_sql("abs"))
def q_element_summary(spark, sf):
    return rp.element_summary(P.scored(spark, sf), "language", "abs")


@register("element_summary_pct", _element_sql("percentage"))
def q_element_summary_pct(spark, sf):
    return rp.element_summary(P.scored(spark, sf), "language", "percentage")


@register("element_summary_prompt", _element_sql("abs", "prompt_id"))
def q_element_summary_prompt(spark, sf):
    return rp.element_summary(P.scored(spark, sf), "prompt_id", "abs")


@register("element_summary_normalized", _element_sql("normalized"))
def q_element_summary_normalized(spark, sf):
    return rp.element_summary(P.scored(spark, sf), "language", "normalized")


@register("element_summary_factor", _element_sql("factor", "prompt_id"))
def q_element_summary_factor(spark, sf):
    return rp.element_summary(P.scored(spark, sf), "prompt_id", "factor")


def _change_sql() -> str:
    rel = ", ".join(f"(updated_{m} - original_{m}) / nullif(CAST(original_{m} AS DOUBLE), 0) AS {m}" for m in M)
    means = ", ".join(f"round_even({O.mean(m)}, 6) AS {m}" for m in ["pass_rate"] + M)
    return W(SCORED + O.minmax_ctes("scored", "sn", H2_COLS) + [
        f"r AS (SELECT repo_name, prompt_id, pass_rate / 100 AS pass_rate, {rel} FROM sn WHERE prompt_id IS NOT NULL)"],
             f"SELECT repo_name, prompt_id, {means} FROM r GROUP BY repo_name, prompt_id")


@register("change_matrix", _change_sql())
def q_change_matrix(spark, sf):
    return rp.change_matrix(P.scored(spark, sf), digits=6)


def _feature_sql(order_only: bool = False) -> str:
    feats = cols.feature_order(["pass_rate"] + cm.metric_columns())
    sel = " UNION ALL ".join(
        f"SELECT repo_name, prompt_id, '{f}' AS feature, {i} AS ord, round_even({O.mean(f'CAST({f} AS DOUBLE)')}, 6) AS value FROM r "
        "GROUP BY repo_name, prompt_id" for i, f in enumerate(feats))
    if order_only:
        sel = f"SELECT DISTINCT feature, ord FROM ({sel})"
    return W(SCORED + O.minmax_ctes("scored", "sn", H2_COLS) + [
        "r AS (SELECT * REPLACE (pass_rate * (SELECT count(DISTINCT prompt_id) FROM scored) / 100 AS pass_rate) "
        "FROM sn WHERE prompt_id IS NOT NULL)"], sel)


@register("feature_distribution", _feature_sql())
def q_feature_distribution(spark, sf):
    return rp.feature_distribution(P.scored(spark, sf), digits=6)


@register("feature_order", _feature_sql(order_only=True))
def q_feature_order(spark, sf):
    """The paired feature order (last ``_`` part, then name; pass rate
    last) of the features present in the I16 output."""
    fd = rp.feature_distribution(P.scored(spark, sf), digits=6)
    return fd.select("feature", "ord").distinct()


@register("describe_events", W([
    "b AS (SELECT round_even(value, 1) AS value FROM events)"], " UNION ALL ".join(
    f"SELECT '{name}' AS statistic, round_even({expr}, 1) AS value FROM b" for name, expr in [
        ("count", "CAST(count(value) AS DOUBLE)"), ("mean", "avg(value)"), ("std", "stddev_samp(value)"),
        ("min", "min(value)"), ("25%", "quantile_cont(value, 0.25)"), ("50%", "quantile_cont(value, 0.5)"),
        ("75%", "quantile_cont(value, 0.75)"), ("max", "max(value)")])))
def q_describe_events(spark, sf):
    """I4 on a continuous column (``events.value``): exact quartiles."""
    return rp.describe(load_table(spark, sf, "events"), columns=["value"])


@register("add_group_stats_events", W([
    "g AS (SELECT event_type, min(value) AS value_min, max(value) AS value_max, "
    "round_even(avg(value), 6) AS value_mean FROM events GROUP BY event_type)"],
    "SELECT e.event_id, e.event_type, e.value, g.value_min, g.value_max, g.value_mean "
    "FROM events e LEFT JOIN g USING (event_type)"))
def q_add_group_stats_events(spark, sf):
    """I1 keyed by ``event_type`` on the events table."""
    ev = load_table(spark, sf, "events").select("event_id", "event_type", "value")
    return rp.add_group_stats(ev, key="event_type", columns=["value"], digits=6)


@register("distinct_keys", W(SCORED, "SELECT DISTINCT repo_name, language FROM scored"))
def q_distinct_keys(spark, sf):
    return rp.distinct_keys(P.scored(spark, sf), ["repo_name", "language"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
