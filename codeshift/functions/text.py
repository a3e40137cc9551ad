"""Whitespace and text helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts, as a Java
# regex class (``str.strip`` and ``re``'s ``\s`` use the same set).
PY_WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The same characters as a literal set, for the (regex-free) trim functions.
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       + "".join(chr(c) for c in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000")

FENCE = "```"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set (character-set trim, no regex)."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def py_rstrip(c) -> Column:
    return F.rtrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def py_lstrip(c) -> Column:
    return F.ltrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def escape_whitespace(c) -> Column:
    """Newline -> the two characters ``\\n``, tab -> ``\\t``."""
    return F.replace(F.replace(col_(c), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def unescape_whitespace(c) -> Column:
    """The inverse of C7.  Lossy: a literal backslash-n in source text also
    becomes a newline, exactly as the transcript reader does."""
    return F.replace(F.replace(col_(c), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def fold_non_ascii(c, repl: str = "?") -> Column:
    """Replace every non-ASCII character by ``repl`` (one char for one char)."""
    return F.regexp_replace(col_(c), r"[^\x00-\x7F]", repl)


def fenced_blocks(c) -> Column:
    """D3: every text between two fences, non-greedy, across lines."""
    return F.regexp_extract_all(col_(c), F.lit(r"(?s)```(.*?)```"), 1)


def has_fence(c) -> Column:
    return F.instr(col_(c), FENCE) > 0


def lines_of(c) -> Column:
    """``text.split('\\n')`` (keeps empty trailing pieces)."""
    return F.split(col_(c), "\n", -1)
