import hashlib
from collections import Counter

from codeshift.llm import suffix_dedup


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k:k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_first(rows, length):
    """Left of each text when windows stay where they occur first (ids differ)."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, r in sorted(raws, key=lambda x: (x[0] is None, x[0] or 0), reverse=True):
        for k in range(len(r) - length, -1, -1):
            first[r[k:k + length]] = (i, k)
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if first[r[k:k + length]] != (i, k):
                gone[k:k + length] = b"\1" * length
        out.append((i, bytes(c for c, g in zip(r, gone) if not g)))
    return out


def report(frame, rows, length, keep_first=False):
    got = suffix_dedup.removal_report(frame(rows), length=length, keep_first=keep_first).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_fixture_against_brute_force(frame, texts):
    assert report(frame, texts, 400) == brute(texts, 400)


def test_short_strings_against_brute_force(frame, texts):
    rows = texts[:40]
    for length in (24, 25, 60):
        assert report(frame, rows, length) == brute(rows, length)


def test_first_places_stay(frame, texts):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    hand = [(1, None), (3, passage), (2, "x" + passage[:50] + "z" + passage[20:]), (4, "a" * 100), (5, "ab" * 60), (None, passage + "!"),
            (7, passage[10:70] + passage[5:60]), (8, "b" + passage[30:] + "a" * 70)]
    for rows, length in ((hand, 30), (hand, 31), (texts[:50], 40), (texts, 240)):
        got = report(frame, rows, length, keep_first=True)
        want = [(i, hashlib.sha256(k).hexdigest()) for i, k in brute_first(rows, length)]
        assert sorted(((r[0], r[4]) for r in got), key=str) == sorted(want, key=str)


def test_edges(frame):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(60))
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "ab" * 300), (6, passage), (7, "é" * 40 + passage + "x"),
            (8, "y" + passage[:50] + "z" + passage[20:]), (9, passage), (9, passage), (None, passage), (None, None),
            (10, "a" * 39), (11, "ñ" + "a" * 41)]
    for length in (40, 41):
        assert report(frame, rows, length) == brute(rows, length)


def test_segments_join(frame, monkeypatch):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(900))
    rows = [(1, text), (2, "--" + text[100:700] + "--" + text[:300])]
    want = brute(rows, 60)
    for segment in (50, 64, 1000):
        got = []
        for first, last, place, h in _runs(text, 60, segment, monkeypatch):
            got += [(w, p) for i, j, p in zip(first.tolist(), last.tolist(), place.tolist()) for w in range(i, j + 1)]
        assert [w for w, _ in got] == list(range(len(text) - 59))
        assert all(w <= p <= w + 30 for w, p in got)
    assert report(frame, rows, 60) == want


def _runs(text, length, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", segment)
    return list(suffix_dedup._Hasher(length).anchors(text.encode()))


def test_empty_table_and_text_left(frame):
    assert report(frame, [], 400) == []
    rows = [(1, "ü" + "q" * 10 + "end"), (2, "q" * 10 + "Ende"), (3, None)]
    left = suffix_dedup.remove_repeats(frame(rows), length=10)
    assert left.columns == frame(rows).columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "üend", 2: "Ende", 3: ""}


def test_tables_on_the_way_are_dropped(spark, frame, texts):
    import os

    from codeshift.session import ensure_checkpoint_dir, local_path
    folder = local_path(ensure_checkpoint_dir(spark))
    before = set(os.listdir(folder))
    spans = suffix_dedup.repeated_spans(frame(texts[:60]), length=60)
    left = {n.split("-")[1] for n in set(os.listdir(folder)) - before}
    assert left == {"spans"} and spans.count() > 0
