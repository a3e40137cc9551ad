"""From transcript messages to (original, updated) code pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, fenced_blocks, has_fence, unescape_whitespace
from .ordinals import running_totals

# The sentence that replaces a fence inside a prompt, and the
# language tag removed from answer blocks.
BUG_FIX_SENTENCE = "Given the above C# code your task is to find and fix bugs in it."
DEFAULT_STRIP_TOKENS = ("csharp",)


def pair_turns(messages: DataFrame) -> DataFrame:
    """Each user message with the message that follows it, kept when that
    one is an assistant answer.

    Written as an equi-join on ``(session_id, idx)`` = ``(session_id,
    next.idx - 1)`` rather than a ``lead`` window: the join key is unique per
    row, so a session with millions of turns spreads over all tasks instead
    of landing in one window partition.  Assumes turn indexes are contiguous
    per session (they are positions in a transcript).
    """
    users = (messages.filter(F.col("role") == "user")
             .select("session_id", "idx", "prompt", F.col("content").alias("user_content")))
    answers = (messages.filter(F.col("role") == "assistant")
               .select("session_id", (F.col("idx") - 1).alias("idx"),
                       F.col("content").alias("answer_content")))
    return users.join(answers, ["session_id", "idx"], "inner")


def filter_answered(turns: DataFrame, answer_col: str = "answer_content") -> DataFrame:
    """Keep pairs whose answer contains a fence."""
    return turns.filter(has_fence(answer_col))


def user_blocks(user_content) -> Column:
    """D3 on the user side: unescape first, then every fenced block."""
    return fenced_blocks(unescape_whitespace(col_(user_content)))


def _remover(token: str):
    # One-argument lambda: a two-argument one is read as (element, index).
    return lambda x: F.replace(x, F.lit(token), F.lit(""))


def merge_answer_blocks(answer_content, strip_tokens=DEFAULT_STRIP_TOKENS,
                        mode: str = "parity") -> Column:
    """Answer blocks joined by newlines; an unclosed fence gives ''.

    ``mode='parity'`` deletes every occurrence of each strip token anywhere in
    the blocks; ``mode='tag_line'`` removes only a leading language tag line.
    """
    blocks = fenced_blocks(col_(answer_content))
    if mode == "tag_line":
        blocks = F.transform(blocks, lambda x: F.regexp_replace(x, r"\A[A-Za-z0-9_#+.-]*\n", ""))
    else:
        for tok in strip_tokens:
            blocks = F.transform(blocks, _remover(tok))
    return F.array_join(blocks, "\n")


def extract_pairs(messages: DataFrame, strip_tokens=DEFAULT_STRIP_TOKENS,
                  answer_mode: str = "parity") -> DataFrame:
    """D1-D4 with row pairing: one pair per answered user turn, whose original
    is the first fenced block of the user message.

    Columns: ``session_id, idx, prompt, original_block, updated_code, n_user_blocks``.
    """
    return turns_to_pairs(pair_turns(messages), strip_tokens, answer_mode)


def turns_to_pairs(turns: DataFrame, strip_tokens=DEFAULT_STRIP_TOKENS,
                   answer_mode: str = "parity", keep=()) -> DataFrame:
    """D2-D4 on ``(session_id, idx, prompt, user_content, answer_content)``
    rows, however they were paired (join, or inside a transcript array).
    ``keep``: further columns of ``turns`` to carry along."""
    turns = filter_answered(turns)
    blocks = user_blocks("user_content")
    return (turns.select(
        "session_id", "idx", "prompt",
        F.get(blocks, 0).alias("original_block"),
        merge_answer_blocks("answer_content", strip_tokens, answer_mode).alias("updated_code"),
        F.size(blocks).alias("n_user_blocks"), *keep)
        .filter(F.col("original_block").isNotNull()))


def zip_pairs(messages: DataFrame, strip_tokens=DEFAULT_STRIP_TOKENS) -> DataFrame:
    """D5 strict parity: positional zip per session of *all* user blocks (of
    answered turns, in order) with all answer texts, cut to the shorter.

    An extra block in one user message shifts every later pair of that
    session, as in the original tool.  Ordinals come from two-level running
    totals, so a huge session is not ranked in one task.  Runs a job: the
    answered turns are written to the checkpoint folder first.
    """
    from ..session import materialize
    # The answered turns are read three times below (ordinals, blocks,
    # answers): write them once so the pairing join runs once.
    turns = materialize(filter_answered(pair_turns(messages)).select(
        "session_id", "idx", "prompt", user_blocks("user_content").alias("_blocks"),
        merge_answer_blocks("answer_content", strip_tokens).alias("updated_code")), "zip-turns")
    # Ordinals come from a narrow (session_id, idx, counts) projection and
    # are joined back once; the wide texts are not carried through the
    # running totals.
    narrow = turns.select("session_id", "idx", F.size("_blocks").alias("_nb"), F.lit(1).alias("_one"))
    ords = running_totals(narrow, ["session_id"], "idx", {"_nb": "_block_base", "_one": "_answer_ord"})
    turns = turns.join(ords.select("session_id", "idx", "_block_base", "_answer_ord"), ["session_id", "idx"])
    originals = turns.select("session_id", F.posexplode("_blocks").alias("_pos", "original_block"),
                             "_block_base").select(
        "session_id", (F.col("_block_base") + F.col("_pos")).alias("_ord"), "original_block")
    answers = turns.select("session_id", F.col("_answer_ord").alias("_ord"), "idx", "prompt",
                           "updated_code")
    return (answers.join(originals, ["session_id", "_ord"], "inner")
            .select("session_id", "idx", "prompt", "original_block", "updated_code",
                    F.col("_ord").alias("pair_ord")))


def extraction_summary(messages: DataFrame, by_session: bool = True) -> DataFrame:
    """User blocks, answer blocks, skipped user turns, and the
    "some code has not been rewritten" flag (block counts differ)."""
    users = messages.filter(F.col("role") == "user").select(
        "session_id", "idx", F.col("content").alias("user_content"))
    answers = (messages.filter(F.col("role") == "assistant")
               .select("session_id", (F.col("idx") - 1).alias("idx"),
                       F.col("content").alias("answer_content")))
    t = users.join(answers, ["session_id", "idx"], "left")
    answered = F.coalesce(has_fence("answer_content"), F.lit(False))
    keys = ["session_id"] if by_session else []
    out = t.groupBy(*keys).agg(
        F.sum(F.when(answered, F.size(user_blocks("user_content"))).otherwise(0))
        .cast("long").alias("n_user_blocks"),
        F.count_if(answered).cast("long").alias("n_answer_blocks"),
        F.count_if(~answered).cast("long").alias("n_skipped"))
    return out.withColumn("some_not_rewritten", F.col("n_user_blocks") != F.col("n_answer_blocks"))


def clean_prompts(df: DataFrame, col: str = "prompt") -> DataFrame:
    """Drop newlines from the prompt, then replace each fence mark in it
    by the fixed bug-fix sentence."""
    c = F.replace(F.replace(F.col(col), F.lit("\n"), F.lit("")), F.lit("```"), F.lit(BUG_FIX_SENTENCE))
    return df.withColumn(col, c)
