import hashlib

import numpy as np

from codeshift.llm import window_dedup


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            place = (i is None, i or 0, k)
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, place), place)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if (i is None, i or 0, k) > first[tuple(w[k:k + window])]:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


def check(frame, rows, window):
    want = brute(rows, window)
    digests = [(i, n, r, hashlib.sha256(k).hexdigest()) for i, n, r, k in want]
    got = window_dedup.removal_report(frame(rows), window=window).collect()
    assert sorted(map(tuple, got), key=str) == sorted(digests, key=str)
    return want


def test_fixture_against_brute_force(frame, texts):
    want = check(frame, texts, 20)
    assert any(r for _, _, r, _ in want)
    left = window_dedup.without_repeats(frame(texts)).collect()
    assert sorted((tuple(r) for r in left), key=str) == sorted(((i, n, r, k.decode()) for i, n, r, k in want), key=str)


def test_short_windows_and_edges(frame, texts):
    words = "the quick brown fox jumps over a lazy dog and runs away from all the noise".split()
    rows = [(1, None), (2, ""), (3, "one two"), (4, "a a a a a a a a"), (5, "x y " * 9), (6, " ".join(words)),
            (7, "\t é  " + " \n".join(words[3:]) + " end"), (8, " ".join(words)), (8, " ".join(words)), (8, "other text of this id"),
            (None, " ".join(words)), (None, " ".join(words)), (None, None), (9, "z " * 3000 + " ".join(words[:5])), (0, words[0])]
    for window in (1, 2, 5):
        check(frame, rows, window)
    check(frame, texts[:60], 3)
    check(frame, [], 20)


def test_many_chunks_and_blocks(spark, frame, texts):
    rows = texts + [(k % 5, f"start {k} " + "shared " * 30 + f"end {k}") for k in range(60)]
    table = window_dedup.chunked(frame(rows).repartition(9), "doc_id", "text")
    assert table.select("chunk").distinct().count() == 9
    spans = window_dedup.repeated_spans(table, 20, bits=12)
    left = table.select("row", "id").join(window_dedup.cut(table, spans, "left"), "row").select("id", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in left), key=str) == sorted(((i, r, k.decode()) for i, _, r, k in brute(rows, 20)), key=str)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 40, 5000).astype(np.uint64)
    hashes = np.concatenate((hashes, hashes[:700]))
    for blocks in (1, 3):
        for row in range(window_dedup.ROWS):
            cells = window_dedup.cells_of(hashes, row, blocks)
            assert (cells[:700] == cells[5000:]).all() and int(cells.max()) >> window_dedup.BITS < blocks
    for numbers in ([], [0], [5, 9, 70000, 70001], [1 << 23], list(range(0, 90000, 7))):
        assert window_dedup.unpack(window_dedup.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_few_windows_pass_the_prefilter(frame):
    """Texts without repeats: the exact pass sees a small share of the windows."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(500))) for i in range(200)]
    table = window_dedup.chunked(frame(rows), "doc_id", "text")
    total = 200 * 481
    blocks = -(-total * window_dedup.CELLS >> window_dedup.BITS)
    seen = window_dedup.merged(window_dedup.partition_sketches(table, 20, blocks))
    assert window_dedup.candidates(table, seen, 20, blocks).count() < total * 0.03
