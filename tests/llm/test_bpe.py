import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from codeshift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

EDGES = ["", " ", "   ", "a", "aaaaaaaaaaa", "é" * 30, "日本語テキスト", "\x00\x01", "don't 'S 12345 ...!!!", "x" * 4000, " " * 300 + "end",
         "tab\t\t new\r\n\r\n  line", "<|endoftext|>", "🎉🎉🎉 ok", "ab" * 700, "...." * 90, "thethethe" * 50]

MORE = [" lead", "a  b", "a \n b", "\n a", "a\u00a0 b", "a \u00a0b", "x 's y", "x' s", "it's 'll 're", " ", "a ", "a  ", "1 2  3", "é è", ". . .", "a\u2003b c"]


def test_replay_is_the_library_on_texts(texts):
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    all_texts = EDGES + MORE + [t for _, t in texts]
    for got, t in zip(c.encode_batch(all_texts), all_texts):
        assert got.tolist() == LIBRARY.encode_ordinary(t)
        assert c.decode(got) == t.encode()


def greedy(piece, ranks):
    """One merge at a time: least rank, then leftmost."""
    parts = [bytes([c]) for c in piece]
    while True:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_replay_with_ranks_out_of_order(seed):
    """Ranks that no training would give: a merge may make a pair of lower rank."""
    rng = random.Random(seed)
    tokens = {bytes(rng.choices(b"ab", k=rng.choice((2, 2, 3, 4)))) for _ in range(14)}
    order = list(tokens)
    rng.shuffle(order)
    ranks = {bytes([k]): 1000 + k for k in range(256)} | {t: k for k, t in enumerate(order)}
    pieces = [bytes(rng.choices(b"abc", k=rng.randrange(0, 14))) for _ in range(300)] + [b"a" * 9, b"ab" * 6]
    flat, lens = bpe.Merges(ranks).replay(pieces)
    got = np.split(flat, np.cumsum(lens)[:-1])
    assert [g.tolist() for g in got] == [greedy(p, ranks) for p in pieces]


def test_query_rows(frame, texts):
    rows = [(1000 + k, t) for k, t in enumerate(EDGES)] + [(None, None), (3, "again"), (3, "again")] + texts[:50]
    got = bpe.token_digests(frame(rows), PATH, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = np.array(LIBRARY.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha((t or "").encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    both = bpe.decode(bpe.encode(frame(rows), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.bytes)) for r in both) == sorted(
        (str(i), np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert bpe.token_digests(frame([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_table_starts_anew_when_full():
    from codeshift.llm.pieces import PieceTable
    calls = []
    t = PieceTable(lambda ps: calls.append(len(ps)) or (np.repeat([len(p) for p in ps], [len(p) for p in ps]),
                                                                 np.array([len(p) for p in ps])), limit=3)
    flat = lambda texts: [i.tolist() for i in t.ids(texts)]
    assert flat([["a", "bb", "a"], ["bb"], []]) == [[1, 2, 2, 1], [2, 2], []]
    assert flat([["ccc", "dddd", "a"]]) == [[3] * 3 + [4] * 4 + [1]] and calls == [2, 2]
    assert flat([["a", "e"]]) == [[1, 1]] and calls == [2, 2, 2]
