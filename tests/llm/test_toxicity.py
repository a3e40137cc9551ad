import zlib

import numpy as np
import pytest

from codeshift.llm import toxicity as tox

LARGE = "/root/testdata/sf0.1"


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    words = [b"ab", b"cde", b"f", b"longer", b"x1", b"y"]
    net = tox.Network.fresh({w: k + 1 for k, w in enumerate(words[:4])})
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows = rng.integers(0, len(words), (3, 7))
    windows[1, 4:] = len(words)
    inputs = rng.standard_normal((len(words) + 1, tox.DIM))
    inputs[-1] = 0
    goal = rng.standard_normal(3)

    def value():
        return float(net.logits(net.projected(inputs), windows) @ goal)

    keep = {}
    net.logits(net.projected(inputs), windows, keep)
    grads = net.backward(windows, inputs, keep, goal)
    for name, g in grads.items():
        w = inputs if name == "inputs" else net.weights[name]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "inputs" and at[0] == len(words) or name == "u" and not tox._BLOCKS[at]:
                continue
            old, eps = w[at], 1e-4
            w[at] = old + eps
            up = value()
            w[at] = old - eps
            down = value()
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 * max(1, abs(g[at])), (name, at)


def test_windows_cover_and_overlap():
    for n in (0, 1, tox.WINDOW, tox.WINDOW + 1, 1000, 1001):
        at = tox.windows_of(n)
        assert at[0] == 0 and at[-1] + tox.WINDOW >= n
        assert (np.diff(at) == tox.STRIDE).all() and (len(at) == 1 or at[-1] < n)


def test_grams_stay_inside_words():
    words = [b"a", b"bcd", "é".encode(), b"x" * 50]
    for size, (codes, at) in zip(tox.SIZES, tox.grams(words)):
        for k, w in enumerate(words):
            alone = tox.grams([w])[tox.SIZES.index(size)][0]
            end = at[k + 1] if k + 1 < len(at) else len(codes)
            assert codes[at[k]:end].tolist() == alone.tolist() and len(alone) == len(w) + 1 + max(tox.SIZES) - 2 - size + 1


def test_batches_do_not_matter():
    net = tox.train(["bad awful words here " * 3, "nice calm words here " * 3] * 30, [1, 0] * 30)
    texts = ["bad awful", "", None, "nice " * 500, "calm bad " * 100]
    alone = [net.score([t])[0] for t in texts]
    assert np.allclose(net.score(texts), alone, atol=1e-6)
    assert alone[0] > 0.5 > alone[3] and alone[1] == alone[2] < 0.5


def test_every_window_counts():
    rng = np.random.default_rng(3)
    net = tox.Network.fresh({})
    split = [[b"w%d" % k for k in rng.integers(0, 300, n)] for n in (0, 1, 5, tox.WINDOW, tox.WINDOW + 1, 700, 3, 2500)]
    texts = [b" ".join(s).decode() for s in split]
    rows = tox.index_windows(split)[0]
    projected = net.projected(net.inputs(list(rows)))
    want = []
    for s in split:
        padded = np.array([rows[x] for x in s] + [len(rows)] * max(0, tox.WINDOW - len(s)))
        want.append(net.logits(projected, np.lib.stride_tricks.sliding_window_view(padded, tox.WINDOW)).max())
    assert np.allclose(net.score(texts), 1 / (1 + np.exp(-np.array(want, float))), atol=1e-5)


@pytest.mark.parametrize("n", [8, 12, 16])
def test_planted_passage_at_every_offset(n):
    """The passage is toxic as a whole; texts with the most of it that is left
    by a border between windows which share six words are clean."""
    rng = np.random.default_rng(n)
    clean = [f"calm{k}" for k in range(1200)]
    passage = [f"vile{k}" for k in range(n)]

    def text(part, size):
        words = rng.choice(clean, size).tolist()
        at = rng.integers(0, size)
        return " ".join(words[:at] + part + words[at:])

    cut = (n - 6) // 2
    parts = [passage if k % 2 else passage[:n - cut] if k % 4 else passage[cut:] for k in range(1200)]
    net = tox.train([text(p, 40) for p in parts], [k % 2 for k in range(1200)])
    words = rng.choice(clean, 120).tolist()
    scores = net.score([" ".join(words[:at] + passage + words[at:]) for at in range(len(words) + 1)])
    assert (scores >= 0.5).all() and net.score([" ".join(words)])[0] < 0.5


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return [(r, known[r.doc_id]) for r in tox.toxicity(docs, labels).collect()]


def test_held_out_accuracy(scored):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r, _ in scored)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r, _ in scored)
    held = [(r.predicted, y) for r, y in scored if r.held_out]
    hit = sum(p == 1 and y == 1 for p, y in held)
    assert hit >= 0.8 * sum(y for _, y in held) and sum(p == 1 and y == 0 for p, y in held) <= 0.02 * len(held)


def test_edges(spark, frame):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 60)] + [(61, 1, None), (None, 1, 1), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = [(i, "vile rotten filth here" if i % 2 else "pleasant weather today here") for i in range(1, 60)]
    rows += [(None, None), (70, ""), (70, ""), (71, "rotten " * 40000), (72, "z" * 100000)]
    got = tox.toxicity(frame(rows), labels).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[71] == 1 and by[70] == 0 and by[None] == 0 and by[1] == 1 and by[2] == 0
    left = tox.drop_toxic(frame(rows), labels)
    assert left.columns == frame(rows).columns and 71 not in [r.doc_id for r in left.collect()]
    assert tox.toxicity(frame([]), labels).collect() == []
    one_kind = labels.where("toxic = 0")
    assert {r.score for r in tox.toxicity(frame(rows[:5]), one_kind).collect()} == {0.0}


def test_sample_is_filled_from_short_texts(spark, frame):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(2000)], "doc_id long, quality int, toxic int")
    rows = [(i, f"text {i}" if i % 10 < 2 else "long " * 100) for i in range(400)]   # most are too long, most ids unknown
    got = tox.training_rows(frame(rows), labels, rows=20, row_bytes=100)
    others = [i for i, t in rows if len(t) <= 100 and i % 2 == 0 and zlib.crc32(str(i).encode()) % 5]
    assert sorted(c for _, c in got) == [0] * min(40, len(others)) + [1] * 20
    assert all(len(t) <= 100 and c == int(t.split()[1]) % 2 for t, c in got)
    only_long = [(i, t if i % 2 == 0 else "long " * 100) for i, t in rows]
    assert {r.score for r in tox.toxicity(frame(only_long), labels, row_bytes=100).collect()} == {0.0}


def test_scores_of_the_table_against_a_plain_scorer(spark):
    """The whole query, and every window of every text on its own."""
    from codeshift.llm import queries
    from codeshift.llm.common import documents, table
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    net = tox.fit(docs, table(spark, sf, "labels"))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = tox.words_of(r.text)
        rows = {w: k for k, w in enumerate(dict.fromkeys(words))}
        line = [rows[w] for w in words] + [len(rows)] * max(0, tox.WINDOW - len(words))
        windows = np.array([line[k:k + tox.WINDOW] for k in range(len(line) - tox.WINDOW + 1)])
        projected = net.projected(net.inputs(list(rows)))
        best = max(float(net.logits(projected, windows[s:s + 4096]).max()) for s in range(0, len(windows), 4096))
        want[r.doc_id] = 1 / (1 + np.exp(-(net.scale * best + net.shift)))
    got = queries.op9_toxicity(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5)


def test_gate_inputs_start_anew(monkeypatch):
    """Few words kept, many met: scores are as with all of them kept."""
    net = tox.train(["bad awful words here " * 3, "nice calm words here " * 3] * 30, [1, 0] * 30)
    texts = [f"word{k} bad thing{k % 7} calm " * 20 for k in range(40)]
    whole = net.score(texts)
    monkeypatch.setattr(tox, "KNOWN", 9)
    known = tox.GateInputs(net)
    parts = np.concatenate([net.score(texts[k:k + 3], known) for k in range(0, 40, 3)])
    assert np.allclose(whole, parts, atol=1e-5) and len(known.rows) < 30


def test_gates_far_outside_the_usual_range_score_like_the_plain_scorer():
    net = tox.Network.fresh({}, 3)
    for k in ("w", "u", "aw"):
        net.weights[k] *= np.float32(60)
    rng = np.random.default_rng(4)
    projected = net.projected(rng.standard_normal((50, tox.DIM)).astype(np.float32) * 3)
    line = rng.integers(0, 50, 300)
    windows = np.lib.stride_tricks.sliding_window_view(line, tox.WINDOW)
    with np.errstate(all="raise", under="ignore"):
        got = net.line_logits(projected, line, step=64)
    assert np.isfinite(got).all()
    assert np.median(np.abs(got - net.logits(projected, windows))) < 1e-3


def test_short_texts_lie_side_by_side(monkeypatch):
    """Windows that span two texts are not worked out; every other one is."""
    rng = np.random.default_rng(5)
    net = tox.Network.fresh({}, seed=2)
    lens = [*rng.integers(33, 80, 300), *rng.integers(0, 33, 40), 513, 544, 2079, 2080, 5000]
    split = [[b"w%d" % k for k in rng.integers(0, 90, n)] for n in lens]
    rows = tox.index_words(split)
    projected = net.projected(net.inputs(list(rows)))
    line, begin, count = tox.lay_out(split, rows)
    want = [net.logits(projected, np.lib.stride_tricks.sliding_window_view(line[b:b + n + tox.WINDOW - 1], tox.WINDOW)).max() for b, n in zip(begin, count)]
    worked, made = [], tox.Network.window_logits

    def counted(self, projected):
        block = made(self, projected)
        return lambda part: worked.append((found := block(part)).size) or found

    monkeypatch.setattr(tox.Network, "window_logits", counted)
    assert np.allclose(net.highest(projected, line, begin, count), want, atol=2e-6)
    spanning = len(line) - tox.WINDOW + 1 - count.sum()      # of texts end to end
    assert 0 <= sum(worked) - count.sum() < spanning / 2
