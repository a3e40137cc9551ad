"""Building snippet x prompt sessions and handling transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_whitespace, py_strip

# The original tool switches from cumulative to independent requests when a
# session has more than this many messages (system + user instructions).
CUMULATIVE_MAX_MESSAGES = 5
REQUEST_COLUMNS = ["session_id", "request_idx", "pos", "role", "content"]


def cross_prompts(snippets: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every snippet with every prompt; snippet is the outer loop.

    ``snippets(snippet_ord, snippet)``, ``prompts(prompt_ord, prompt)`` with
    0-based dense ordinals; ``ord = snippet_ord * n_prompts + prompt_ord``.
    The product is the definition; Spark plans it by the size of the sides.
    """
    counted = prompts.crossJoin(F.broadcast(prompts.agg(F.count(F.lit(1)).alias("_np"))))  # one row on the right
    return snippets.crossJoin(counted).select(
        "snippet_ord", "snippet", "prompt_ord", "prompt",
        (F.col("snippet_ord") * F.col("_np") + F.col("prompt_ord")).cast("long").alias("ord"))


def render_turn(snippet, prompt):
    """``\\n## User \\n`` + fenced snippet + prompt + newline."""
    return F.concat(F.lit("\n## User \n```\n"), snippet, F.lit("\n```\n"), prompt, F.lit("\n"))


def design_size(snippets: DataFrame, prompts: DataFrame, group_df: DataFrame | None = None,
                group_col: str | None = None) -> DataFrame:
    """Number of snippet x prompt combinations (one row), and with a
    group column its share per group value: design / count_distinct(group)."""
    s = snippets.agg(F.count(F.lit(1)).alias("n_snippets"))
    p = prompts.agg(F.count(F.lit(1)).alias("n_prompts"))
    out = s.crossJoin(F.broadcast(p)).withColumn(
        "design_size", (F.col("n_snippets") * F.col("n_prompts")).cast("long"))
    if group_df is not None and group_col is not None:
        g = F.broadcast(group_df.agg(F.count_distinct(group_col).alias("n_groups")))
        out = out.crossJoin(g).withColumn(
            "per_group", F.try_divide(F.col("design_size").cast("double"), F.col("n_groups").cast("double")))
    return out


def _instruction_counts(messages: DataFrame) -> DataFrame:
    """Per session: system + user messages (the instructions of a replay)."""
    return (messages.filter(F.col("role") != "assistant").groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("n_instructions")))


def context_cumulative(messages: DataFrame, max_messages: int | None = None) -> DataFrame:
    """C4: for each user turn, the history up to and including it.

    Long form ``(session_id, request_idx, pos, role, content)``, of every
    session; ``max_messages`` restricts it to sessions with at most that many
    instructions (the C6 split: the others are replayed independently).
    """
    m = messages
    if max_messages is not None:
        short = _instruction_counts(messages).filter(F.col("n_instructions") <= max_messages)
        m = messages.join(short.select("session_id"), "session_id", "left_semi")
    users = m.filter(F.col("role") == "user").select("session_id", F.col("idx").alias("request_idx"))
    hist = m.select("session_id", F.col("idx").alias("pos"), "role", "content")
    return (users.join(hist, "session_id").filter(F.col("pos") <= F.col("request_idx"))
            .select(*REQUEST_COLUMNS))


def context_independent(messages: DataFrame, min_messages: int | None = None) -> DataFrame:
    """For each user turn only [system message, this turn].

    ``min_messages`` restricts it to sessions with more instructions than
    that (the C6 split).  Long form as C4, ``pos`` 0 for the system message.
    """
    m = messages
    if min_messages is not None:
        long_ = _instruction_counts(messages).filter(F.col("n_instructions") > min_messages)
        m = messages.join(long_.select("session_id"), "session_id", "left_semi")
    users = m.filter(F.col("role") == "user").select(
        "session_id", F.col("idx").alias("request_idx"), F.col("idx").alias("pos"), "role", "content")
    system = m.filter(F.col("role") == "system").select(
        "session_id", F.col("idx").alias("pos"), "role", "content")
    sys_rows = (users.select("session_id", "request_idx").join(system, "session_id")
                .select(*REQUEST_COLUMNS))
    return users.select(*REQUEST_COLUMNS).unionByName(sys_rows)


def stored_independent(messages: DataFrame) -> DataFrame:
    """C5's stored transcript: user contents escaped (C7), others as they are."""
    return messages.withColumn(
        "content", F.when(F.col("role") == "user", escape_whitespace("content")).otherwise(F.col("content")))


def build_requests(messages: DataFrame, max_messages: int = CUMULATIVE_MAX_MESSAGES) -> DataFrame:
    """Cumulative requests for short sessions, independent ones for
    sessions with more than ``max_messages`` instructions.

    Two shuffles by session: one brings a session's number of instructions and
    its system messages together (partial aggregation first), one brings them
    to its messages, where a skewed session is split.  Then a short session is
    gathered, which its few instructions bound, and its histories are made in
    the row; a user turn of a long session is a group of its own with the
    system messages beside it, so no long session is ever gathered.
    """
    message = F.struct(F.col("idx").alias("pos"), "role", "content")
    facts = messages.groupBy("session_id").agg(
        F.count_if(F.col("role") != "assistant").alias("_n"),
        F.collect_list(F.when(F.col("role") == "system", message)).alias("_system"))
    joined = messages.join(facts, "session_id")
    short = F.col("_n") <= max_messages
    alone = F.when(short, F.lit(None)).otherwise(F.col("idx"))
    turns = (joined.where(short | (F.col("role") == "user")).withColumn("_alone", alone)
             .groupBy("session_id", "_alone", "_n", "_system").agg(F.array_sort(F.collect_list(message)).alias("_all")))
    # (request_idx, messages) of each user turn: all up to it, or itself and the system messages.
    users = F.filter("_all", lambda m: m["role"] == "user")
    requests = F.transform(users, lambda u: F.struct(u["pos"].alias("request_idx"), F.when(
        short, F.filter("_all", lambda m: m["pos"] <= u["pos"])).otherwise(F.concat(F.array(u), F.col("_system"))).alias("all")))
    mode = F.when(short, F.lit("cumulative")).otherwise(F.lit("independent")).alias("mode")
    return (turns.select("session_id", mode, F.explode(requests).alias("_r"))
            .select("session_id", "mode", "_r.request_idx", F.explode("_r.all").alias("_m"))
            .select("session_id", "request_idx", "_m.pos", "_m.role", "_m.content", "mode"))


def escape_messages(df: DataFrame, col: str = "content") -> DataFrame:
    """C7 on a column."""
    return df.withColumn(col, escape_whitespace(col))


def parse_completion(responses: DataFrame) -> DataFrame:
    """Keep status 200, take ``choices[0].message.content``, strip it."""
    content = F.get_json_object("body", "$.choices[0].message.content")
    return (responses.filter(F.col("status") == 200)
            .select(*[c for c in responses.columns if c not in ("status", "body")],
                    F.lit("assistant").alias("role"), py_strip(content).alias("content")))


def transcript_view(messages: DataFrame) -> DataFrame:
    """System dropped; ``Model: `` / ``User: `` prefixes by lower-cased role."""
    r = F.lower(F.col("role"))
    line = (F.when(r == "assistant", F.concat(F.lit("Model: "), F.col("content")))
            .when(r == "user", F.concat(F.lit("User: "), F.col("content"))))
    return messages.select("session_id", "idx", line.alias("line")).filter(F.col("line").isNotNull())
