"""Distances between the original and the updated text."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col_, fold_non_ascii


# Accented letters of the texts, and control characters that
# stand for them where an engine counts bytes.
LETTERS = "äöüßÄÖÜéèêàçîôûùëñáíóúÉÈÊÀÇÑ"
STAND_INS = "".join(chr(c) for c in [*range(1, 9), 11, 12, *range(14, 32)])


# First band of the banded search, and its growth.
BAND, GROWTH = 32, 4


def _banded(a: Column, b: Column) -> Column:
    """Levenshtein distance by growing bands.  A band of t costs length times t
    and gives -1 when the distance is beyond it, so near texts cost about length
    times distance.  Bands of over an eighth of the longer text would save little and
    are left out; the last one is the longer text itself, which always suffices."""
    both = F.array(F.struct(a.alias("a"), b.alias("b")))  # worked out once, named by the lambda

    def search(s):
        longest = F.greatest(F.length(s["a"]), F.length(s["b"]))
        steps = F.filter(F.array(*[F.lit(BAND * GROWTH ** k) for k in range(8)]), lambda t: t * 8 <= longest)
        found = F.aggregate(F.concat(steps, F.array(longest)), F.lit(-1), lambda d, t: F.when(d >= 0, d).otherwise(
            F.call_function("levenshtein", s["a"], s["b"], t)))
        return F.when(s["a"].isNotNull() & s["b"].isNotNull(), found)

    return F.transform(both, search)[0]


def edit_distance(a, b, threshold: int | None = None, fold: bool = False) -> Column:
    """Character Levenshtein distance (JVM-side), exact.

    Without ``threshold`` it is found by growing bands, so near texts are cheap
    however long they are.  ``threshold`` gives -1 for pairs further apart than
    it.  ``fold`` maps accented letters one to one to control characters
    first, which leaves the distance as it is; use it only when the result must
    agree with an engine that counts bytes.
    """
    a, b = col_(a), col_(b)
    if fold:
        a, b = (fold_non_ascii(F.translate(x, LETTERS, STAND_INS)) for x in (a, b))
    if threshold is None:
        return _banded(a, b)
    return F.levenshtein(a, b, threshold)


def _similarity(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    return F.lit(1.0) - F.try_divide(distance.cast("double"), longest)


def edit_similarity(a, b, distance: Column | None = None) -> Column:
    """E5: 1 - distance / longest length; NULL when both texts are empty."""
    a, b = col_(a), col_(b)
    d = distance if distance is not None else edit_distance(a, b)
    return _similarity(d, a, b)


def run_distance(a: str, b: str) -> int:
    """Run-based distance over the character diff ``difflib.ndiff(a, b)``.

    Every stretch of inserted/deleted characters between two kept characters
    costs the larger of its insert and delete counts.  Always at least the
    Levenshtein distance.

    Computed from the same opcodes as ``ndiff`` without generating its text.
    ``ndiff`` refines each ``replace`` block by searching for similar
    "lines"; with one-character lines no similarity ratio can reach its
    cutoff, so the refinement reduces to: sync on the first equal pair (outer
    loop over ``b``, inner over ``a``) and recurse on both sides, else emit
    the block as deletions and insertions.  That search is ``str.find`` here,
    and the recursion uses an explicit stack.  The tests hold it against hand
    pairs and properties.
    """
    from difflib import SequenceMatcher

    total = ins = dels = 0
    for tag, alo, ahi, blo, bhi in SequenceMatcher(None, a, b).get_opcodes():
        if tag == "equal":
            total += ins if ins > dels else dels
            ins = dels = 0
        elif tag == "delete":
            dels += ahi - alo
        elif tag == "insert":
            ins += bhi - blo
        else:
            stack = [(alo, ahi, blo, bhi)]
            while stack:
                item = stack.pop()
                if item is None:  # the equal character of a sync point
                    total += ins if ins > dels else dels
                    ins = dels = 0
                    continue
                a0, a1, b0, b1 = item
                if a0 < a1 and b0 < b1:
                    for j in range(b0, b1):
                        i = a.find(b[j], a0, a1)
                        if i >= 0:
                            stack += [(i + 1, a1, j + 1, b1), None, (a0, i, b0, j)]
                            break
                    else:
                        dels += a1 - a0
                        ins += b1 - b0
                else:
                    dels += a1 - a0
                    ins += b1 - b0
    return total + (ins if ins > dels else dels)


@F.pandas_udf(T.LongType())
def _ndiff_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if (x is None or y is None) else run_distance(x, y) for x, y in zip(a, b)], dtype="Int64")


def ndiff_distance(a, b) -> Column:
    """The run-based distance as an iterator pandas UDF (whole texts).  Its
    cost is the product of the lengths: see ``codemetrics.dealt_by_cost``."""
    return _ndiff_udf(col_(a), col_(b))


def syntactic_similarity(a, b, distance: Column | None = None) -> Column:
    """1 - E6 / longest length; negative when E6 exceeds the longer text."""
    a, b = col_(a), col_(b)
    d = distance if distance is not None else ndiff_distance(a, b)
    return _similarity(d, a, b)
