"""Per-text line profiles, computed inside the row.

The profile is one ``aggregate`` over the stripped lines of the text, so it
needs no shuffle and no explode: a table of N texts stays N rows.  The comment
state (inside an open ``/* ... */`` block or not) is carried in the
accumulator, which is what makes a plain ``transform`` insufficient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WHITESPACE, col_, lines_of, py_strip

PROFILE_FIELDS = ("LOC", "comment", "blank", "chars", "tokens", "comment_per_LOC")


def _acc(inc, loc, cmt, blank, chars, tokens) -> Column:
    return F.struct(inc.alias("in_comment"), loc.alias("LOC"), cmt.alias("comment"),
                    blank.alias("blank"), chars.alias("chars"), tokens.alias("tokens"))


# Non-whitespace runs, with Python's whitespace set.
NON_WS_RUN = "[^" + PY_WHITESPACE[1:-1] + "]+"


def token_count(line) -> Column:
    """Number of ``\\S+`` runs in a line.  ``regexp_count`` keeps its literal
    pattern compiled across rows (``split`` by a regex class would compile it
    again for every line)."""
    return F.regexp_count(line, F.lit(NON_WS_RUN))


def comment_ratio(comment, loc) -> Column:
    """Comment / LOC, -1 when LOC is 0."""
    comment, loc = col_(comment), col_(loc)
    return F.when(loc == 0, F.lit(-1.0)).otherwise(comment.cast("double") / loc.cast("double"))


# One letter per class of a line.
LINE_CLASSES = {"b": "blank", "c": "comment", "l": "loc"}
_CHUNK = 256


def line_classes(stripped) -> Column:
    """The class letter of each stripped line, by the rules of ``line_profile``.

    The state (inside an open block or not) is carried by ``aggregate`` in two
    levels: letters of up to 256 lines are put together in an inner one, and the
    outer one joins those, so long texts do not copy their letters line by line."""
    lines = col_(stripped)

    def step(a, s):
        starts = s.startswith("/*")
        ends = s.endswith("*/")
        line = s.startswith("//")
        letter = F.when(s == "", "b").when(line | starts | ends | a["open"], "c").otherwise("l")
        still = F.when(starts & ~ends, True).when(ends & ~starts & ~line, False).otherwise(a["open"])
        return F.struct(F.concat(a["letters"], letter).alias("letters"), still.alias("open"))

    def chunk(a, k):
        inner = F.aggregate(F.slice(lines, k * _CHUNK + 1, F.lit(_CHUNK)),
                            F.struct(F.lit("").alias("letters"), a["open"].alias("open")), step)
        # One struct, used twice: bound as the only element of an array.
        return F.transform(F.array(inner), lambda i: F.struct(
            F.concat(a["letters"], i["letters"]).alias("letters"), i["open"].alias("open")))[0]

    chunks = F.sequence(F.lit(0), ((F.size(lines) - 1) / _CHUNK).cast("int"))
    done = F.aggregate(chunks, F.struct(F.lit("").alias("letters"), F.lit(False).alias("open")), chunk)
    return F.when(F.size(lines) > 0, F.slice(F.split(done["letters"], ""), 1, F.size(lines)))


def line_profile(code) -> Column:
    """struct<LOC, comment, blank, chars, tokens, comment_per_LOC>.

    Line rules (applied to the stripped line, first match wins): empty ->
    blank; starts ``//`` -> comment; starts ``/*`` and ends ``*/`` -> comment;
    starts ``/*`` -> comment, opens a block; ends ``*/`` -> comment, closes the
    block; inside an open block -> comment; otherwise a code line, which adds
    its stripped length to ``chars`` and its whitespace-separated runs to
    ``tokens``.  A blank line inside a block stays blank.
    """
    lines = F.transform(lines_of(code), lambda l: py_strip(l))
    zero = F.lit(0)
    init = _acc(F.lit(False), zero, zero, zero, zero, zero)

    def step(a, s):
        starts_line = s.startswith("//")
        starts_block = s.startswith("/*")
        ends_block = s.endswith("*/")
        return (
            F.when(s == "", _acc(a.in_comment, a.LOC, a.comment, a.blank + 1, a.chars, a.tokens))
            .when(starts_line | (starts_block & ends_block),
                  _acc(a.in_comment, a.LOC, a.comment + 1, a.blank, a.chars, a.tokens))
            .when(starts_block, _acc(F.lit(True), a.LOC, a.comment + 1, a.blank, a.chars, a.tokens))
            .when(ends_block, _acc(F.lit(False), a.LOC, a.comment + 1, a.blank, a.chars, a.tokens))
            .when(a.in_comment, _acc(a.in_comment, a.LOC, a.comment + 1, a.blank, a.chars, a.tokens))
            .otherwise(_acc(a.in_comment, a.LOC + 1, a.comment, a.blank,
                            a.chars + F.length(s), a.tokens + token_count(s)))
        )

    def finish(a):
        return F.struct(a.LOC.alias("LOC"), a.comment.alias("comment"), a.blank.alias("blank"),
                        a.chars.alias("chars"), a.tokens.alias("tokens"),
                        comment_ratio(a.comment, a.LOC).alias("comment_per_LOC"))

    return F.aggregate(lines, init, step, finish)


# String literals of one line (possessive: linear, no stack).
PY_STRINGS = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""


def python_raw_profile(code) -> Column:
    """Raw counts for ``#``-commented code.

    ``loc`` is the number of lines, ``comments`` those with a comment, also
    behind code (a ``#`` outside string literals of one line), ``blank`` empty
    stripped lines, ``sloc`` lines that are neither blank nor comment only.
    Logical lines (a tokenizer notion) are not computed.
    """
    lines = F.transform(lines_of(code), lambda l: py_strip(l))
    loc = F.size(lines)
    blank = F.size(F.filter(lines, lambda s: s == ""))
    only = F.size(F.filter(lines, lambda s: s.startswith("#")))
    comments = F.size(F.filter(lines, lambda s: F.regexp_replace(s, PY_STRINGS, "").contains("#")))
    return F.struct(loc.alias("loc"), (loc - blank - only).alias("sloc"),
                    comments.alias("comments"), blank.alias("blank"))
