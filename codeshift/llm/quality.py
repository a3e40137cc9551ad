r"""Quality rules with risk-controlled thresholds, DataFrame functions only.

Words are ``[^\x20\x09-\x0D]+``.  Every text gets counts (words, code points in
words, symbols, repeated lines, repeated words) and, from these, a few ratios
in which junk stands out.  A rule rejects a text whose ratio is beyond a cutoff.

Cutoffs are not chosen by hand.  Per rule there is a fixed list of candidates.
The labelled good documents of a stratum (language) are dealt to two halves by a
digest of their id.  The first half only orders: the steps of all rules, each a
rule taking its next stricter candidate, are put into one path, those that reject
the fewest first.  The second half tests the path from its beginning: after each
step, the exact binomial tail must rule out, at level ``delta`` divided by the
number of strata (Bonferroni), that all rules together reject more than ``alpha`` of
the good documents of the stratum.  The path was fixed before these rows were
looked at and testing stops at the first step that fails, so the steps of a
stratum need no further correction (fixed-sequence testing).  With probability
1 - delta no stratum loses more than a share ``alpha`` of its good documents.  A rule
that rejects good documents comes late in the path and does not hold up the
others; a stratum with too few labels (under about 460 in its second half at
1 %, 5 % and five strata) gets no rule.  The base checks (under 50 words; over half
of the words repeated) come on top.

The repeated three-word windows of a text are found by sorting: window hashes
and places share one number, so windows whose hash bits meet are neighbours
after a sort of plain numbers; only these (or all, in a text of over 2^20 words)
are then sorted as pairs of full hash and place.

Defined cases: null text has no words; null languages are a stratum; null
labels are ignored and several labels of one id count as the lowest; documents
that repeat are judged row by row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, whole_text

MIN_WORDS, WINDOW = 50, 3
ALPHA, DELTA = 0.01, 0.05
_PLACE = 20

# Rule, the ratio it looks at, and its candidate cutoffs from strict to loose.
RULES = {
    "symbols": ("symbol_ratio", (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2)),
    "lines": ("dup_line_ratio", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    "repeats": ("repeat_ratio", (0.02, 0.05, 0.1, 0.2, 0.3, 0.4)),
    "marks": ("mark_ratio", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "capitals": ("upper_ratio", (0.1, 0.2, 0.3, 0.5)),
    "long_words": ("word_length", (8.0, 9.0, 10.0, 12.0, 15.0)),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _only(text: Column, chars: str) -> Column:
    """The characters of ``text`` in the class ``chars``."""
    return F.regexp_replace(text, f"[^{chars}]+", "")


def _lines(text: Column) -> Column:
    """Number of lines with a word, and how many of them repeat an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeat")))


def _covered(places: Column, n: Column) -> Column:
    """Words covered by windows at the (sorted) places: each window adds what
    the next one does not start before."""
    return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).cast("long").alias("last")),
                       lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("sum"),
                                               p.alias("last")), lambda acc: acc["sum"])


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur at least twice."""
    n = F.size(w)
    hashes = F.transform(F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    high, low = F.lit(-(1 << _PLACE)).cast("long"), F.lit((1 << _PLACE) - 1).cast("long")

    def from_pairs(pairs: Column) -> Column:
        """``pairs`` of window hash and place, in any order: equal hashes are neighbours once sorted."""
        near = lambda p, i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
        return _let(F.sort_array(pairs), lambda p: _covered(F.sort_array(F.filter(
            F.transform(p, lambda x, i: F.when(near(p, i, i - 1) | near(p, i, i + 1), x["at"])), lambda x: x.isNotNull())), n))

    def fast(h: Column) -> Column:
        """Sort numbers of hash bits and place; pairs only where hash bits meet."""
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))

        def meeting(p: Column) -> Column:
            same = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: x.bitwiseXOR(y).bitwiseAND(high) == 0)
            return _let(same, lambda e: F.when(~F.coalesce(F.array_contains(e, True), F.lit(False)), zero).otherwise(
                from_pairs(F.transform(
                    F.filter(p, lambda x, i: F.coalesce(F.get(e, i), F.lit(False)) | F.coalesce(F.get(e, i - 1), F.lit(False))),
                    lambda x: _pair(h, x.bitwiseAND(low))))))

        return _let(packed, meeting)

    zero = F.lit(0).cast("long")
    return F.when(n <= WINDOW, zero).otherwise(_let(hashes, lambda h: F.when(n >= 1 << _PLACE, from_pairs(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("at"))))).otherwise(fast(h))))


def _pair(hashes: Column, place: Column) -> Column:
    return F.struct(F.get(hashes, place.cast("int")).alias("h"), place.alias("at"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, counts, base_failed and the ratios of the rules; no shuffle."""
    t = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _only(t, r"!?|#*$%&<>{}\[\]=_~^\\").alias("marks"), F.length(_only(t, "A-Z")).alias("n_upper"),
        _lines(t).alias("lines"),
        _let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))).alias("w"))
    n, chars = F.col("w.n"), F.col("word_chars")
    rows = rows.withColumn("n_symbols", F.length(_only(F.col("marks"), r"#*$%&|<>")).cast("long"))
    per = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    return rows.select(
        "id", "stratum", n.alias("n_words"), "word_chars", "n_symbols", F.col("lines.repeat").cast("long").alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * F.col("w.repeat") > 50 * n)).alias("base_failed"),
        per(F.col("n_symbols"), chars).alias("symbol_ratio"), per(F.col("lines.repeat"), F.col("lines.n")).alias("dup_line_ratio"),
        per(F.col("w.repeat"), n).alias("repeat_ratio"), per(F.length("marks"), n).alias("mark_ratio"),
        per(F.col("n_upper"), chars).alias("upper_ratio"), per(chars, n).alias("word_length"))


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable with n trials, in logarithms, exactly
    summed term by term.  ``k`` is under n * p + 1 where it is used."""
    odds = F.log(F.lit(p) / (1 - p))
    start = n * F.log(F.lit(1 - p))
    acc = F.struct(start.alias("term"), start.alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + odds
        high = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(a["sum"] - high) + F.exp(term - high))).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, acc, lambda a, j: add(a, j.cast("double")), lambda a: F.exp(F.least(a["sum"], F.lit(0.0))))


def first_half(id_col: Column) -> Column:
    """Whether a labelled document belongs to the half that orders the steps."""
    return F.substring(F.md5(id_col.cast("string")), 1, 1) < "8"


def _steps(rules: dict) -> list[tuple[str, str, int, float]]:
    """rule, ratio, how strict (0: loosest), cutoff of every step."""
    return [(rule, ratio, i, c) for rule, (ratio, cs) in rules.items() for i, c in enumerate(reversed(cs))]


def paths(explored: DataFrame, strata: DataFrame, rules: dict = RULES) -> DataFrame:
    """stratum and, per step, its place in the stratum's path.  Stricter steps of a
    rule reject no less, so they come later; where equal many are rejected, looser
    steps come first."""
    steps = _steps(rules)
    counts = explored.groupBy("stratum").agg(*(
        F.count_if(F.col(ratio) > c).alias(f"k{j}") for j, (_, ratio, _, c) in enumerate(steps)))
    known = strata.alias("s").join(counts.alias("c"), F.col("s.stratum").eqNullSafe(F.col("c.stratum")), "left")
    order = F.array_sort(F.array(*(F.struct(F.coalesce(F.col(f"c.k{j}"), F.lit(0)).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j"))
                                   for j, (_, _, i, _) in enumerate(steps))))
    placed = known.select(F.col("s.stratum").alias("stratum"), F.transform(order, lambda x: x["j"]).alias("path"))
    return placed.select("stratum", *((F.array_position("path", j) - 1).alias(f"at{j}") for j in range(len(steps))))


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """stratum and one column per rule: the strictest cutoff that the path reached,
    or null.  ``labelled``: features of the labelled good documents that pass the
    base, and ``explore``: whether they belong to the first half."""
    steps = _steps(rules)
    tested = labelled.where(~F.col("explore"))
    # One row per stratum from here on.
    sizes = tested.groupBy("stratum").agg(F.count(F.lit(1)).cast("double").alias("n"))
    placed = materialize(paths(labelled.where("explore"), sizes.select("stratum"), rules), "paths")
    on = tested.alias("t").join(checked_broadcast(placed).alias("p"), F.col("t.stratum").eqNullSafe(F.col("p.stratum")))
    # The step from which a document is rejected; null where none rejects it.
    falls = F.least(*(F.when(F.col(f"t.{ratio}") > c, F.col(f"p.at{j}")) for j, (_, ratio, _, c) in enumerate(steps)), F.lit(None).cast("long"))
    lost = on.select(F.col("t.stratum").alias("stratum"), falls.alias("falls")).groupBy("stratum").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *(F.count_if(F.col("falls") <= j).cast("double").alias(f"k{j}") for j in range(len(steps))))
    strata = sizes.agg(F.count(F.lit(1)).alias("strata"))
    level = F.lit(delta) / F.col("strata")
    fails = F.array(*(~((F.col(f"k{j}") <= F.col("n") * alpha) & F.coalesce(_tail(F.col(f"k{j}"), F.col("n"), alpha) <= level, F.lit(False)))
                      for j in range(len(steps))))
    first = F.array_position(fails, True)
    reached = lost.join(F.broadcast(strata)).select(                       # ``strata`` is a single row
        "stratum", F.when(first > 0, first - 1).otherwise(F.lit(len(steps))).alias("reached"))
    both = reached.alias("r").join(checked_broadcast(placed).alias("p"), F.col("r.stratum").eqNullSafe(F.col("p.stratum")))
    strictest = {rule: [F.when(F.col(f"p.at{j}") < F.col("r.reached"), F.lit(c)) for j, (name, _, _, c) in reversed(list(enumerate(steps)))
                        if name == rule] for rule in rules}
    return both.select(F.col("r.stratum").alias("stratum"), *(F.coalesce(*cs).alias(rule) for rule, cs in strictest.items()))


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
             alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """id, counts, base_failed, kept and ``failed_rules``; one row per document."""
    rows = materialize(features(docs, id_col, text_col, stratum_col), "features")
    good = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).where("_quality = 1").select("_id"))
    holdout = rows.join(good, rows["id"] == good["_id"], "left_semi").where(~F.col("base_failed")) \
        .withColumn("explore", first_half(F.col("id")))
    chosen = materialize(cutoffs(holdout, alpha, delta, rules), "cutoffs")
    r, c = rows.alias("r"), chosen.alias("c")
    fails = {rule: F.coalesce(F.col(f"r.{ratio}") > F.col(f"c.{rule}"), F.lit(False)) for rule, (ratio, _) in rules.items()}
    judged = r.join(c, F.col("r.stratum").eqNullSafe(F.col("c.stratum")), "left")
    return judged.select(F.col("r.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~reduce(or_, fails.values())).alias("kept"),
                         F.concat_ws(",", *(F.when(x, F.lit(rule)) for rule, x in fails.items())).alias("failed_rules"))
