import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codeshift.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True

EDGES = ["", " \n ", "Don't STOP 'Re", "É é  x y", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x1f c", "日本 語", "Σας ΣΑΣ", "x" * 3000,
         "word " * 5000, "́ accent first", "İstanbul", "🎉 ok\x0bz", "a\u0085b", "a\u00a0B", "ÀÉÎ ñandú ǅ Ǆx ŉ ß ẞ", "e\u0301 É", "One, two. THREE,four.five", "end,. x", "wait..", "a 3.5, b", "'S, 't. it's, (x), y.", "ÉTÉ, Ñu. İ, ß.",
         "a\u2026, b", "3×4, 5÷6.", "dz\u01c5, x", "\u0149, x", "a,\u0301 b", "x\xb2, y", "ª, º.", "Σ, Σ.", "'RE don't ''s", "\x7f\x80 \xad x\xady", "\x01", "mark \x01 x\x01y"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def test_words_are_the_library(texts):
    all_texts = EDGES + [t for _, t in texts]
    for got, t in zip(packing.words(PATH).encode_batch(all_texts), all_texts):
        assert got.tolist() == ids_of(t)[:-1], t[:50]


def check(rows, got, capacity=2048):
    want = []
    for i, t in rows:
        ids = ids_of(t)
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s:s + capacity], "<u4")
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == Counter(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_query_rows(frame, texts):
    rows = texts + [(1000 + k, t) for k, t in enumerate(EDGES)] + [(None, None), (5, "again"), (5, "again")]
    got = packing.pack_documents(frame(rows), PATH).collect()
    bins, tokens = check(rows, got)
    assert bins == -(-tokens // 2048)          # no sequence more than the lower bound here
    assert packing.pack_documents(frame([]), PATH).collect() == []


def test_ids_on_demand(frame):
    rows = [(1, "some words to carry"), (2, "x " * 30)]
    for r in packing.pack_documents(frame(rows), PATH, capacity=16, with_ids=True).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == ids_of(dict(rows)[r.doc_id])[r.start:r.start + r["length"]]


def least_bins(lengths, capacity):
    """Exact minimum by exhaustive search."""
    items = sorted(lengths, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        tried = set()
        for i, r in enumerate(rooms):
            if r >= items[k] and r not in tried:
                tried.add(r)
                go(k + 1, rooms[:i] + [r - items[k]] + rooms[i + 1:])
        go(k + 1, rooms + [capacity - items[k]])
    go(0, [])
    return best


def test_search_against_exhaustive_minimum():
    better = 0
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [rng.randint(15, 60) for _ in range(11)]
        first = packing.best_fit_types(Counter(lengths), 100)
        types = packing.search(first, 100)
        for t in (first, types):
            assert Counter(x for u, n in t.items() for x in u for _ in range(n)) == Counter(lengths)
            assert all(sum(u) <= 100 for u in t)
        least = least_bins(lengths, 100)
        assert least <= sum(types.values()) <= min(sum(first.values()), least + 1)
        better += sum(types.values()) < sum(first.values())
    assert better


def test_large_histogram_meets_the_bound():
    rng = random.Random(5)
    lengths = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(200000))
    lengths[700] += 100000                      # a third of all pieces are copies
    types = packing.search(packing.best_fit_types(lengths))
    assert sum(len(t) * n for t, n in types.items()) == sum(lengths.values())
    total = sum(k * n for k, n in lengths.items())
    assert sum(types.values()) <= -(-total // 2048) * 1.001 + 1
    table = packing.slots(types)
    assert len(table) < 60000


def improves(a, b, capacity):
    """Whether a piece moved, or one exchanged for one or two, raises the squared fills."""
    fa, fb = sum(a), sum(b)
    give = lambda t: {0, *t}, lambda t: {x + y for i, x in enumerate(t) for y in t[i + 1:]}
    return any(fa - d <= capacity and fb + d <= capacity and (fa - d) ** 2 + (fb + d) ** 2 > fa * fa + fb * fb
               for i, j in ((0, 0), (0, 1), (1, 0)) for x in give[i](a) for y in give[j](b) for d in (x - y,))


def test_search_ends_where_no_step_helps():
    rng = random.Random(7)
    lengths = Counter(rng.randint(600, 1100) for _ in range(2000))   # hundreds of underfull types
    first = packing.best_fit_types(lengths)
    types = packing.search(first)
    assert Counter(x for u, n in types.items() for x in u for _ in range(n)) == lengths
    assert sum(types.values()) < sum(first.values())
    underfull = sorted(t for t in types if sum(t) < 2048)
    assert len(underfull) > 100 and all(sum(t) <= 2048 for t in types)
    for i, a in enumerate(underfull):
        for b in underfull[i if types[a] > 1 else i + 1:]:
            assert not improves(a, b, 2048), (a, b)


def test_search_in_shares_places_all_and_ends():
    """Work does not grow with the number of pieces; the gap to the bound is small."""
    import time
    rng = np.random.default_rng(5)
    for n, lo, hi, gap in ((5_000_000, 200, 500, 0.001), (1_000_000, 200, 500, 0.001), (300_000, 20, 900, 0.001), (5_000_000, 500, 900, 0.06)):
        lengths = Counter(rng.integers(lo, hi + 1, n).tolist())
        start = time.time()
        types = packing.packed_types(lengths)
        assert time.time() - start < 60
        placed = Counter()
        for t, k in types.items():
            assert sum(t) <= 2048 and k > 0
            for x in t:
                placed[x] += k
        bound = -(-sum(x * k for x, k in lengths.items()) // 2048)
        assert placed == lengths and sum(types.values()) <= bound * (1 + gap) + 1
        assert sum(types.values()) <= sum(packing.best_fit_types(lengths).values())


def test_few_pieces_are_searched_as_a_whole():
    rng = np.random.default_rng(6)
    for lo, hi in ((300, 900), (600, 1100), (1, 2048)):
        lengths = Counter(rng.integers(lo, hi + 1, 900).tolist())
        whole = packing.search(packing.best_fit_types(lengths))
        assert sum(packing.packed_types(lengths).values()) == sum(whole.values())
    assert packing.packed_types({}) == Counter() and packing.packed_types({2048: 3}) == Counter({(2048,): 3})
    assert packing.packed_types({7: 5}, share=1) == Counter({(7,) * 5: 1})
