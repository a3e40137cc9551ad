import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from codeshift.llm import quality

BLANK = " \t\n\x0b\f\r"


def brute(text):
    t = text or ""
    w = [x for x in re.split(f"[{BLANK}]+", t) if x]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(BLANK)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


EDGES = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\n x\ny", "é ñ \x1c z\x0bq", "#$ %&|<> ** #",
         "a b c d a b c e b c d", "w " * 3000, " ".join(f"w{i % 997}" for i in range(5000)), "\n".join(["line one", "line one "] * 4)]


def test_counts_against_brute_force(frame, texts):
    rows = list(enumerate(EDGES)) + [(None, "null id"), (3, "one")] + [(1000 + i, t) for i, t in texts]
    got = quality.features(frame(rows)).collect()
    key = ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[k] for k in key) for r in got) == Counter((i, *brute(t)) for i, t in rows)
    assert quality.features(frame([])).collect() == []


def test_meeting_hash_bits_and_very_long_texts(frame, texts, monkeypatch):
    """With few place bits every text takes the way of very long ones; with few
    hash bits left, different windows meet and must be told apart."""
    rows = list(enumerate(EDGES)) + [(1000 + i, t) for i, t in texts[:40]]
    for place in (3, 58):
        monkeypatch.setattr(quality, "_PLACE", place)
        got = {r["id"]: r.n_repeat_words for r in quality.features(frame(rows)).collect()}
        assert got == {i: brute(t)[4] for i, t in rows}


def tail(k, n, p):
    return float(sum(comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 500), (3, 700), (9, 2000), (40, 9000), (0, 100000)]
    p = Fraction(1, 200)
    frame = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double")
    got = frame.select(quality._tail(F.col("k"), F.col("n"), float(p)).alias("t")).collect()
    for (k, n), r in zip(cases, got):
        assert r.t == pytest.approx(tail(k, n, p) if n < 10000 else (1 - 0.005) ** n, rel=1e-8)


RULES = {"a": ("symbol_ratio", (0.1, 0.3)), "b": ("mark_ratio", (0.5,))}


def path_cutoffs(rows, rules, alpha, delta):
    """The method on plain rows (stratum, ratios by name, explore)."""
    steps = [(rule, ratio, i, c) for rule, (ratio, cs) in rules.items() for i, c in enumerate(reversed(cs))]
    strata = {s for s, _, explore in rows if not explore}
    out = {}
    for s in strata:
        first, second = ([r for t, r, e in rows if t == s and e == half] for half in (True, False))
        path = sorted(range(len(steps)), key=lambda j: (sum(r[steps[j][1]] > steps[j][3] for r in first), steps[j][2], j))
        now, n = {}, len(second)
        for j in path:
            rule, ratio, _, c = steps[j]
            then = {**now, rule: (ratio, c)}
            k = sum(any(r[x] > y for x, y in then.values()) for r in second)
            if k > n * alpha or tail(k, n, alpha) > delta / len(strata):
                break
            now = then
        out[s] = {rule: now[rule][1] if rule in now else None for rule in rules}
    return out


def test_cutoffs_keep_their_promise(spark):
    """A rule that rejects good documents does not hold up the others; few labels prove nothing."""
    rng = random.Random(1)
    rows = [(lang, {"symbol_ratio": rng.choice([0.2, 0.4]) if rng.random() < share else 0.0, "mark_ratio": 1.0 if rng.random() < 0.3 else 0.0},
             rng.random() < 0.5)
            for lang, n, share in (("many", 3000, 0.002), ("often", 3000, 0.05), ("few", 300, 0.0), (None, 1500, 0.0), ("none", 40, 0.5))
            for _ in range(n)]
    rules = {"a": ("symbol_ratio", (0.1, 0.3, 0.5)), "b": ("mark_ratio", (0.5, 1.5))}
    table = spark.createDataFrame([(s, r["symbol_ratio"], r["mark_ratio"], e) for s, r, e in rows],
                                  "stratum string, symbol_ratio double, mark_ratio double, explore boolean")
    got = {r.stratum: {"a": r.a, "b": r.b} for r in quality.cutoffs(table, 0.01, 0.05, rules).collect()}
    assert got == path_cutoffs(rows, rules, 0.01, 0.05)
    assert got["many"] == {"a": 0.1, "b": 1.5} and got["often"] == {"a": 0.5, "b": 1.5} and got[None] == {"a": 0.1, "b": 1.5}
    assert set(got["few"].values()) == set(got["none"].values()) == {None}
    for s, cuts in got.items():                       # no more than alpha of the tested rows is lost
        second = [r for t, r, e in rows if t == s and not e]
        assert sum(any(c is not None and r[rules[k][0]] > c for k, c in cuts.items()) for r in second) <= 0.01 * len(second)


def test_false_rejection_stays_below_alpha(spark):
    """Over many draws at the worst true share, a wrong promise is as rare as delta says."""
    rng = random.Random(3)
    rows = [(f"s{d}", 1.0 if rng.random() < 0.02 else 0.0, 0.0, rng.random() < 0.5) for d in range(60) for _ in range(900)]
    table = spark.createDataFrame(rows, "stratum string, symbol_ratio double, mark_ratio double, explore boolean")
    got = quality.cutoffs(table, 0.02 - 1e-9, 0.05 * 60, {"a": ("symbol_ratio", (0.5,))}).collect()
    assert sum(r.a is not None for r in got) <= 9     # 5 % of 60 strata, and chance


def test_verdicts(spark, frame):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}#$" for i in range(60))
    rows = [(i, clean + f" n{i}") for i in range(1, 1400)] + [(2000 + i, junk + f" j{i}") for i in range(20)] + [(None, junk), (3000, "few words"), (3000, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 1400)] + [(i, 1, None) for i in range(1, 5)] + [(2000, 0, 0), (2001, None, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.verdicts(frame(rows), labels, alpha=0.01, rules=RULES).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id < 2000) for r in got)
    assert {r.base_failed for r in got if r.doc_id == 3000} == {True}
    assert all(r.kept for r in quality.verdicts(frame(rows[:50]), labels.limit(0)).collect())
    assert quality.verdicts(frame([]), labels).collect() == []
