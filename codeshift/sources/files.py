"""File sources.

Each file is one unit (a snippet, a prompt list, a session, a transcript), so
``wholetext`` reads give one row per file and all parsing happens inside the
row with array functions: no window and no shuffle.  The file name comes from
the ``_metadata`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import list_folders, on_disk, read_files
from ..functions.text import lines_of, py_rstrip
from ..operators.ordinals import running_total

# The system message prepended to replayed sessions.
DEFAULT_SYSTEM_PROMPT = ("You are a world-class programmer and a helpful assistant that follows "
                         "requirements to the letter. Answer all queries truthfully, precisely and "
                         "to the best of your ability with a single code block.")

MESSAGE_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("prompt", T.StringType()),
]))

_METRIC_NAMES = ("LOC", "comment", "blank", "chars", "tokens")


def _record_json_fields() -> list[T.StructField]:
    f = [T.StructField(n, T.StringType()) for n in
         ("repo_url", "repo_name", "local_path", "path_to_snippet", "snippet_func_name",
          "snippet_line_start", "snippet_line_end", "language", "run_command", "prerequisites")]
    for side in ("original", "updated"):
        f += [T.StructField(f"{side}_{m}", T.LongType()) for m in _METRIC_NAMES]
        f += [T.StructField(f"{side}_comment/LOC", T.DoubleType()),
              T.StructField(f"{side}_levenshtein_distance", T.LongType()),
              T.StructField(f"{side}_syntactic_similarity", T.DoubleType()),
              T.StructField(f"{side}_cyclomatic_complexity", T.LongType())]
    f += [T.StructField(n, T.StringType()) for n in ("original_code", "updated_code", "prompt")]
    f += [T.StructField("build_success", T.LongType()), T.StructField("test_success", T.StringType())]
    return f


RECORD_JSON_SCHEMA = T.StructType(_record_json_fields())


def list_by_core(spark: SparkSession) -> None:
    """Let a listing of many folders or files be as many tasks as keep all cores
    busy.  Spark's own number is a task a folder, up to 10,000; with a folder per
    session, starting the tasks takes most of the time."""
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # no context (e.g. Spark Connect): the engine decides
        return
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * cores))


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; partition columns of the folder layout are kept."""
    list_by_core(spark)
    df = spark.read.text(path, wholetext=True)
    return df.select(*[c for c in df.columns if c != "value"],
                     F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def scan_snippets(spark: SparkSession, path: str) -> DataFrame:
    """A1: each regular file below ``path`` is one snippet (whole text)."""
    return _whole_files(spark, path).withColumnRenamed("text", "snippet")


def parse_prompts(text_df: DataFrame, text_col: str = "text") -> DataFrame:
    """A2 on a text column: lines starting ``- ``, minus those two
    characters, right-stripped, numbered in file order."""
    kept = F.filter(lines_of(text_col), lambda l: l.startswith("- "))
    keys = [c for c in text_df.columns if c != text_col]
    return (text_df.select(*keys, F.posexplode(kept).alias("prompt_ord", "_line"))
            .select(*keys, "prompt_ord", py_rstrip(F.substr(F.col("_line"), F.lit(3))).alias("prompt")))


def scan_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A2: prompt list file(s) -> ``(file_name, prompt_ord, prompt)``."""
    return parse_prompts(_whole_files(spark, path).drop("file_path"))


def parse_session_markdown(text_df: DataFrame, text_col: str = "text",
                           system_prompt: str = DEFAULT_SYSTEM_PROMPT, ends: Column | None = None) -> DataFrame:
    """A3 on a text column: session markdown -> messages.

    A line starting ``## User`` opens a user message; the lines after it
    (with their newlines, joined by one space) are its content; text before
    the first marker is dropped unless there is no marker at all (then it is
    one message without a role).  ``prompt`` is the second-last line of the
    message (the last line for the final one).  Empty messages are skipped.
    A system message is prepended at ``idx`` 0.  ``ends``: whether the end of a
    text is the end of its session (default: always).
    """
    keys = [c for c in text_df.columns if c != text_col]
    chunks = F.split(F.col(text_col), r"(?m)^## User[^\n]*(\n|\z)", -1)
    n = F.size(chunks)
    ends = F.lit(True) if ends is None else ends
    tagged = F.transform(chunks, lambda c, i: F.struct(c.alias("body"), ((i == n - 1) & ends).alias("last"),
                                                      (i == 0).alias("pre")))
    # Drop the preamble when a marker exists, and every empty chunk.
    kept = F.filter(tagged, lambda s: (s["body"] != "") & ~(s["pre"] & (n > 1)))
    ex = text_df.select(*keys, (n > 1).alias("_has_marker"),
                        F.posexplode(kept).alias("_pos", "_c"))
    body = F.col("_c.body")
    ends_nl = body.endswith("\n")
    parts = F.split(body, "\n", -1)
    real = F.when(ends_nl, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    prompt = (F.when(F.col("_c.last"),
                     F.concat(F.element_at(real, -1), F.when(ends_nl, F.lit("\n")).otherwise(F.lit(""))))
              .otherwise(F.concat(F.try_element_at(real, F.lit(-2)), F.lit("\n"))))
    content = F.regexp_replace(body, r"\n(?!\z)", "\n ")
    msgs = ex.select(*keys, (F.col("_pos") + 1).alias("idx"),
                     F.when(F.col("_has_marker"), F.lit("user")).alias("role"),
                     content.alias("content"), prompt.alias("prompt"))
    system = text_df.select(*keys, F.lit(0).alias("idx"), F.lit("system").alias("role"),
                            F.lit(system_prompt).alias("content"), F.lit(None).cast("string").alias("prompt"))
    return system.unionByName(msgs)


def parse_session_turns(turns: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """A3 on rows of turns ``(session, ord, text)`` as ``render_turn`` makes them:
    the messages that the turns of a session, put together, parse to.

    A turn starts with the newline that ends the one before.  With that newline
    moved back, every turn is parsed alone, so a long session is never one
    value; only the session's last place and the number of messages before a
    turn (narrow tables) are joined to it."""
    last = turns.groupBy("session").agg(F.max("ord").alias("_last"))
    end = F.col("ord") == F.col("_last")
    body = F.concat(F.regexp_replace("text", r"\A\n", ""), F.when(end, F.lit("")).otherwise(F.lit("\n")))
    whole = turns.join(last, "session").select("session", "ord", end.alias("end"), body.alias("text"))
    parsed = parse_session_markdown(whole, "text", system_prompt, ends=F.col("end")).where("idx > 0")
    before = running_total(parsed.groupBy("session", "ord").agg(F.count(F.lit(1)).alias("n")), ["session"], "ord", "n", "before")
    users = parsed.join(before.select("session", "ord", "before"), ["session", "ord"]).select(
        "session", (F.col("before") + F.col("idx")).cast("int").alias("idx"), "role", "content", "prompt")
    return users.unionByName(last.select("session", F.lit(0).alias("idx"), F.lit("system").alias("role"),
                                         F.lit(system_prompt).alias("content"), F.lit(None).cast("string").alias("prompt")))


def scan_session_markdown(spark: SparkSession, path: str,
                          system_prompt: str = DEFAULT_SYSTEM_PROMPT, layout: str = "files") -> DataFrame:
    """A3: session markdown file(s) -> ``(file_name, idx, role, content, prompt)``,
    or the rendered turns that ``write_session_markdown(layout="lines")`` wrote ->
    ``(session, idx, role, content, prompt)``."""
    if layout == "lines":
        return parse_session_turns(spark.read.schema("session string, ord long, text string").json(path), system_prompt)
    return parse_session_markdown(_whole_files(spark, path).drop("file_path"), "text", system_prompt)


def parse_chat_json(text_df: DataFrame, text_col: str = "text") -> DataFrame:
    """A4 on a text column holding one JSON array of messages."""
    keys = [c for c in text_df.columns if c != text_col]
    arr = F.from_json(F.col(text_col), MESSAGE_SCHEMA)
    return (text_df.select(*keys, F.posexplode(arr).alias("idx", "_m"))
            .select(*keys, "idx", "_m.role", "_m.content", "_m.prompt"))


MESSAGE_LINES = "session_id string, idx long, role string, content string, prompt string"


def scan_chat_json(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """A4: the transcripts that ``write_chat_json`` wrote -> messages with their
    index, ``model`` and ``run_ts``.  ``layout="lines"``: message lines
    (splittable; text ids).  ``"files"``: files that hold a top-level array;
    ``read.json(multiLine)`` is not used there: it loses the position."""
    if layout == "lines":
        return spark.read.schema(MESSAGE_LINES).json(path)
    return parse_chat_json(_whole_files(spark, path))


def _records_from_struct(r: str) -> list:
    cols = []
    for f in RECORD_JSON_SCHEMA.fields:
        name = f.name.replace("comment/LOC", "comment_per_LOC")
        c = F.col(f"{r}.`{f.name}`")
        if name in ("snippet_line_start", "snippet_line_end"):
            c = c.try_cast("int")
        elif name.endswith(_METRIC_NAMES) or name.endswith("cyclomatic_complexity"):
            c = c.cast("int")
        elif name == "build_success":
            c = c.cast("int")
        if name in ("local_path", "prerequisites"):
            continue
        cols.append(c.alias(name))
    return cols


def scan_records(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """A5: record files -> the ``records`` table.

    ``layout='array'`` reads files holding one JSON array of records (the
    original tool's format; slash in ``comment/LOC``); ``'lines'`` reads JSON
    lines as written by ``write_records(fmt='json')`` (splittable).
    """
    if layout == "array":
        arr = F.from_json(F.col("text"), T.ArrayType(RECORD_JSON_SCHEMA))
        df = _whole_files(spark, path).select("file_name", F.posexplode(arr).alias("pos", "_r"))
        return df.select("file_name", "pos", *_records_from_struct("_r"))
    return spark.read.schema(_lines_schema()).json(path)


def _lines_schema() -> T.StructType:
    from ..operators.codemetrics import RECORD_COLUMNS  # local import: avoid a cycle
    ints = {f"{s}_{m}" for s in ("original", "updated") for m in _METRIC_NAMES + ("cyclomatic_complexity",)}
    fields = []
    for c in [*RECORD_COLUMNS, "build_success", "test_success"]:
        if c in ints or c == "build_success" or c in ("snippet_line_start", "snippet_line_end"):
            t = T.IntegerType()
        elif c.endswith("levenshtein_distance") or c == "idx":
            t = T.LongType()
        elif c.endswith(("comment_per_LOC", "syntactic_similarity")):
            t = T.DoubleType()
        else:
            t = T.StringType()
        fields.append(T.StructField(c, t))
    return T.StructType(fields)


def parse_run_names(names: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Split ``<session>_<yyyy-MM-dd>_<HH?mm>_<model>.json`` names.  The
    separator inside the time part is ignored (``17:28`` or ``17-28``)."""
    parts = F.split(F.col(name_col), "_", -1)
    t = F.get(parts, 3)
    ts_text = F.concat(F.get(parts, 2), F.lit(" "), F.substr(t, F.lit(1), F.length(t) - 3),
                       F.lit(":"), F.substr(t, F.length(t) - 1, F.lit(2)))
    return names.select("*", F.get(parts, 0).alias("_p0"), F.get(parts, 1).alias("_p1"),
                        F.get(parts, 4).alias("_p4"),
                        F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd HH:mm")).alias("run_ts"))


def _is_test(name_col: str):
    """A whole part of the name (between ``_``, ``-`` and ``.``) is ``test`` or ``example``."""
    return F.col(name_col).rlike(r"(?:^|[_.-])(?:tests?|examples?)(?:[_.-]|$)")


def latest_run(names: DataFrame, session_name: str, model: str, exclude_test: bool = False,
               name_col: str = "file_name") -> DataFrame:
    """The latest run file of one session and model.

    A name matches when its first part, or its first two parts joined by
    ``_``, equal ``session_name`` and its fifth part contains ``model``;
    ``exclude_test`` also skips names with a part ``test`` or ``example``.
    Ties on the timestamp go to the smallest file name.
    """
    p = parse_run_names(names, name_col)
    match = (((F.col("_p0") == session_name) | (F.concat_ws("_", "_p0", "_p1") == session_name))
             & F.coalesce(F.col("_p4").contains(model), F.lit(False)) & F.col("run_ts").isNotNull())
    if exclude_test:
        match = match & ~_is_test(name_col)
    return (p.filter(match)
            .agg(F.min_by(F.struct(F.col(name_col).alias("file_name"), F.col("run_ts")),
                          F.struct(-F.unix_timestamp("run_ts"), F.col(name_col))).alias("_w"))
            .select("_w.*").filter(F.col("file_name").isNotNull()))


def latest_runs(names: DataFrame, exclude_test: bool = False, name_col: str = "file_name") -> DataFrame:
    """A6 for every (session, model): session = first two parts, model =
    fifth part without ``.json``."""
    p = parse_run_names(names, name_col)
    p = p.withColumn("session", F.concat_ws("_", "_p0", "_p1")).withColumn(
        "model", F.regexp_replace(F.col("_p4"), r"\.json\z", ""))
    p = p.filter(F.col("run_ts").isNotNull() & F.col("model").isNotNull())
    if exclude_test:
        p = p.filter(~_is_test(name_col))
    return (p.groupBy("session", "model")
            .agg(F.min_by(F.struct(F.col(name_col).alias("file_name"), F.col("run_ts")),
                          F.struct(-F.unix_timestamp("run_ts"), F.col(name_col))).alias("_w"))
            .select("session", "model", "_w.file_name", "_w.run_ts"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: name, path and partition columns.  Contents are not read."""
    listed = list_folders(spark, path)
    if listed is not None:
        return listed
    list_by_core(spark)
    df = spark.read.format("binaryFile").load(path)
    parts = [c for c in df.columns if c not in ("path", "modificationTime", "length", "content")]
    return df.select(F.element_at(F.split(F.col("path"), "/"), -1).alias("file_name"), "path", *parts)


def read_chosen(spark: SparkSession, base: str, chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Name and text of the whole files whose ``path`` is in ``chosen``, and no others,
    with its partition columns ``keys``.  On a disk tasks open them.  Elsewhere their
    names pass through the driver, as the names of all files of a folder do whenever
    Spark lists it; contents do not."""
    if on_disk(spark, base):
        return read_files(chosen, keys, 4 * spark.sparkContext.defaultParallelism)
    list_by_core(spark)
    paths = [r["path"] for r in chosen.select("path").collect()]
    if not paths:
        return _whole_files(spark, base).limit(0).select(*keys, "file_name", "text")
    df = spark.read.option("basePath", base).text(paths, wholetext=True)
    return df.select(*keys, F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
