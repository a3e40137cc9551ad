"""McCabe complexity as 1 + decision points of the first function.

McCabe ("A Complexity Measure", IEEE TSE 1976) counts one plus the number of
decision points.  Here the decision points are counted by regular expression
on the text after comments and string literals are blanked, from the first
function definition to the next one, which is an approximation of a
parser-based count.  Non-ASCII characters are folded to ``#`` first so that
the word boundary ``\\b`` means the same on every regex engine.

All runs are possessive: no pattern backtracks into them, so matching is
linear in the text and needs no stack, also on generated or minified code
(megabyte literals, base64, long identifiers).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, fold_non_ascii

# Decision-point patterns.
C_DECISIONS = r"\b(if|for|foreach|while|case|catch)\b|&&|\|\||\?"
PY_DECISIONS = r"\b(if|elif|for|while|except|and|or|assert)\b"

# Comments and string/char literals, leftmost match wins; a comment that is
# never closed runs to the end.
C_NOISE = (r"""(?s)/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)|//[^\n]*+"""
           r"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'(?:[^'\\\n]|\\.)'""")
PY_NOISE = r"""#[^\n]*+|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""

# Heads of statements that look like a function definition but are none.
C_HEADS = r"\b(if|for|foreach|while|switch|catch|using|lock|fixed)\s*+\("

# Something that looks like a function definition.
C_FUNCTION = r"\b[A-Za-z_][A-Za-z0-9_]*+\s*+\([^()]*+\)\s*+(?:\{|=>)"
PY_FUNCTION = r"\bdef\s++[A-Za-z_][A-Za-z0-9_]*+\s*+\("


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _clean(code, style: str) -> Column:
    noise = C_NOISE if style == "c" else PY_NOISE
    return F.regexp_replace(fold_non_ascii(col_(code), "#"), noise, " ")


def _count(text: Column, style: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(C_DECISIONS if style == "c" else PY_DECISIONS), 0))


def _first_function(cleaned: Column, style: str) -> Column:
    """Text from behind the first definition up to the next; NULL without one."""
    if style == "c":
        cleaned = F.regexp_replace(cleaned, C_HEADS, "$1 [")
    return F.get(F.split(cleaned, C_FUNCTION if style == "c" else PY_FUNCTION, 3), F.lit(1))


def complexity_profile(code, style: str = "c") -> Column:
    """struct(decision_points, complexity): decision points of the whole text
    and E8/E13 of its first function, from one cleaned text."""
    return _let(_clean(code, style), lambda t: F.struct(
        _count(t, style).alias("decision_points"), (F.lit(1) + _count(_first_function(t, style), style)).alias("complexity")))


def decision_points(code, style: str = "c") -> Column:
    return _count(_clean(code, style), style)


def cyclomatic_complexity(code, style: str = "c", require_function: bool = True) -> Column:
    """E8 (``style='c'``) / E13 (``style='python'``) of the first function.

    NULL when nothing function-like is found, which stands for "unknown" (the
    record keeps -1 for it, see ``combine_metrics``).  ``require_function=False``
    counts over the whole text instead.
    """
    if not require_function:
        return F.lit(1) + decision_points(code, style)
    return F.lit(1) + _count(_first_function(_clean(code, style), style), style)


def python_complexity(code, require_function: bool = True) -> Column:
    return cyclomatic_complexity(code, style="python", require_function=require_function)
