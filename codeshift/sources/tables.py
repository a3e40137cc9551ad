"""Parquet tables and the transcript-shaped views derived from them.

The driver tables hold prose.  ``session_messages`` turns
``conversations(conv_id, turn, role, text)`` into chat transcripts whose user
turns carry a fenced, headed code block and whose answers come in the four
shapes the extractor has to handle (no fence, unclosed fence, two blocks, one
block).  Everything here is a column expression over the scanned table, so a
scan of N rows stays N rows and no shuffle is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition by ``keys`` when the input has fewer partitions than
    the cluster has task slots, so that CPU-heavy per-row work (regexes and
    array functions over long texts) uses every core.  A large input already
    arrives in many splits and is left as it is (no extra shuffle)."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # no RDD access (e.g. Spark Connect): leave the input as it is
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


NL = "\n"

# The literal replacements that make prose look like C-family
# code (statements, line and block comments, branch keywords and operators).
CODE_REWRITES = [
    (". ", ";" + NL),
    ("." + NL, ";" + NL + NL),
    (NL + "E", NL + "// E"),
    (NL + "A", NL + "/* A"),
    (";" + NL + "T", " */" + NL + "T"),
    (";" + NL + "D", " */" + NL + "D"),
    (" the ", " if "),
    (" die ", " while "),
    (" de ", " for "),
    (" and ", " && "),
    (" und ", " || "),
    (" la ", " catch "),
]


# Function heads of the code view, and the break where another one starts.
FUNCTION_HEAD = "int run(int a) {" + NL
PYTHON_HEAD = "def run(a):" + NL
NEXT_FUNCTION = (";" + NL + "I", ";" + NL + "}" + NL + "int next(int b) {" + NL + "I")


def as_code(text) -> Column:
    """Prose -> code-like text by the literal rewrites above, in order; four
    texts of five (by length) start with a function head."""
    c = F.col(text) if isinstance(text, str) else text
    code = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), [*CODE_REWRITES, NEXT_FUNCTION], c)
    return F.when(F.length(c) % 5 == 0, code).otherwise(F.concat(F.lit(FUNCTION_HEAD), code))


# Lines that lead the code of a session.
LEAD_LINES = ("// note" + NL, NL, "x = x;" + NL)


# A second block of a user turn.
SECOND_BLOCK = NL + "see also" + NL + "```" + NL + "int other;" + NL + "```"


def as_python(text) -> Column:
    """Prose with a function head in four texts of five (by length)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) % 5 == 0, c).otherwise(F.concat(F.lit(PYTHON_HEAD), c))


def _s(c: Column) -> Column:
    return c.cast("string")


def session_messages(conversations: DataFrame) -> DataFrame:
    """Transcript rows ``(session_id, idx, role, content, prompt)``."""
    # As many comment, blank and statement lines ahead as the repository's number,
    # and a function in all code of four repositories: the least value of every
    # metric differs between repositories.
    repo = F.col("conv_id") % 6
    lead = F.concat(*[F.repeat(F.lit(x), repo.cast("int")) for x in LEAD_LINES],
                    F.when(repo >= 2, F.lit(FUNCTION_HEAD)).otherwise(F.lit("")))
    c = conversations.select("conv_id", "turn", "role", "text", F.concat(lead, as_code("text")).alias("code"))
    conv, turn, code = F.col("conv_id"), F.col("turn"), F.col("code")
    prompt = F.concat(F.lit("prompt "), _s((conv + turn) % 8))
    language = (F.when(conv % 3 == 0, F.lit("c#")).when(conv % 3 == 1, F.lit("c++"))
                .otherwise(F.lit("python")))
    user = F.concat(
        F.lit("```\n // src/file"), _s(conv), F.lit(".cs\n // "),
        _s(turn * 10), F.lit("/"), _s(turn * 10 + 5), F.lit("\n // https://example.com/org/repo"),
        _s(conv % 6), F.lit("\n // "), language, F.lit("\n"), code, F.lit("\n ```\n"), prompt)
    kind = (conv + turn) % 7
    assistant = (
        F.when(kind == 0, code)
        .when((kind == 1) & (conv % 6 < 3), F.concat(F.lit("```"), code))
        .when(kind == 2, F.concat(F.lit("```csharp\n"), code, F.lit("\n```\nand\n```"), code, F.lit("```")))
        .otherwise(F.concat(F.lit("Here:\n```csharp\n"), code, F.lit("\n```"))))
    user = F.when((conv + turn) % 11 == 3, F.concat(user, F.lit(SECOND_BLOCK))).otherwise(user)
    role = F.col("role")
    # A quarter of the conversations are parts of long sessions, with gaps in their index.
    part = conv % 20 - 15
    session = F.when(part >= 0, conv - part).otherwise(conv)
    idx = F.when(part >= 0, part * 100 + turn).otherwise(turn).cast(conversations.schema["turn"].dataType)
    return c.select(
        session.alias("session_id"), idx.alias("idx"), role,
        F.when(role == "user", user).when(role == "assistant", assistant)
        .otherwise(F.col("text")).alias("content"),
        F.when(role == "user", prompt).otherwise(F.lit("")).alias("prompt"))


def code_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with its text rewritten as code: ``(doc_id, source, lang, code)``."""
    return spread(documents.select("doc_id", "source", "lang", "text"), "doc_id").select(
        "doc_id", "source", "lang", as_code("text").alias("code"))


def messages_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_messages(load_table(spark, sf_dir, "conversations"))


def stored_responses(messages: DataFrame) -> DataFrame:
    """API responses as they would be stored: one per assistant turn.

    ``status`` is 500 for answers without any code fence (the request failed
    to produce code) and 200 otherwise; ``body`` is the JSON text
    ``{"choices":[{"message":{"content": ...}}]}`` with the answer padded by
    whitespace (the parser strips it).
    """
    a = messages.filter(F.col("role") == "assistant")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.concat(F.lit("  "), F.col("content"), F.lit("\n")).alias("content")).alias("message"))
    ).alias("choices")))
    status = F.when(F.instr(F.col("content"), "```") > 0, F.lit(200)).otherwise(F.lit(500))
    return a.select("session_id", "idx", status.alias("status"), body.alias("body"))


def build_logs(labels: DataFrame, messages: DataFrame) -> DataFrame:
    """Build outcomes standing in for compiler runs: one per user turn whose
    session has a row in ``labels``.

    The command fails (``exit_code`` 1) when label and turn say so; the log says
    ``Build succeeded.`` when ``quality`` is 1, ``Build FAILED.`` when 0 and
    nothing when it is missing.  Keyed by ``session_id`` (= ``doc_id``) and ``idx``.
    """
    log = (F.when(F.col("quality") == 1, F.lit("Build succeeded."))
           .when(F.col("quality") == 0, F.lit("Build FAILED.")).otherwise(F.lit("")))
    turns = messages.where(F.col("role") == "user").select("session_id", "idx")
    named = labels.select(F.col("doc_id").alias("session_id"), F.coalesce("toxic", F.lit(0)).alias("_toxic"), log.alias("log"))
    return turns.join(named, "session_id").select(
        "session_id", "idx", F.when((F.col("_toxic") + F.col("idx")) % 3 == 0, 1).otherwise(0).alias("exit_code"), "log")
