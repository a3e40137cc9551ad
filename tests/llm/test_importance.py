import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from codeshift.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10_000, grams=1, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, grams)[1])
    t = Counter(bucket(f) for x in target for f in features(x, grams)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, fs = features(text, grams)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    ranked = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(ranked[:percent * len(ranked) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, frame, docs, target, **options):
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    return sorted(map(tuple, importance.resample(frame(docs), goal, **options).collect()), key=str)


def test_fixture_against_brute_force(spark, frame, texts):
    goal = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert resampled(spark, frame, texts, goal) == brute(texts, goal)
    assert resampled(spark, frame, texts, goal, grams=2, buckets=100, percent=40) == brute(texts, goal, 100, 2, percent=40)


def test_edges_and_ties(spark, frame):
    long = "alpha Beta gamma " * 40_000
    docs = [(1, None), (2, ""), (3, "... !"), (4, "short text"), (5, long), (6, "É é 日本 x1 " * 9), (7, "a b c d e " * 5),
            (7, "a b c d e " * 5), (7, "a b c d e " * 5), (None, "a b c d e " * 5), (None, "a b c d e " * 5), (None, None)]
    for percent in (0, 10, 34, 100):
        assert resampled(spark, frame, docs, ["alpha x1", None, "b"], percent=percent) == brute(docs, ["alpha x1", None, "b"], percent=percent)
    assert resampled(spark, frame, docs, []) == brute(docs, [])
    assert resampled(spark, frame, [], ["alpha"]) == []


def test_one_score_for_most_rows(spark, frame):
    docs = [(9, "w " * 25)] * 300 + [(i, "w v " * 12) for i in range(60)]
    assert resampled(spark, frame, docs, ["w"], percent=50) == brute(docs, ["w"], percent=50)


def test_planes_give_the_sums():
    rng = np.random.default_rng(1)
    for low, high, buckets in ((-9000, 12000, 1000), (-1, 0, 70), (0, 0, 64), (3, 4, 5), (-20, -19, 130)):
        gain = rng.integers(low, high + 1, buckets)
        planes, counts = importance.gain_planes(gain)
        rows, at = rng.integers(0, 7, 5000), rng.integers(0, buckets, 5000) ** 2 % buckets
        want = np.bincount(rows, gain[at], 7).astype(np.int64)
        assert (importance.weight_sums(rows, at, 7, planes, counts) == want).all()
        assert (importance.weight_sums(rows[:0], at[:0], 7, planes, counts) == 0).all()
