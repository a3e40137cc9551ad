import hashlib
import re

import numpy as np
import pytest

from codeshift.llm import infill, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


EDGES = [None, "", " ", " \t\n", "a", " a", "a ", "é", "  é  ß x ", "\U0001F600 \U0001F600a", "日本 語\n\n", "x<", "<P", "a<S", ">",
         "has <M> a mark", "<P>", "a\u0085b c d", "\x00 \x1f a", "nul\x00", "é" * 3000 + " " + "z" * 70000, "w " * 5000]


def test_edges_against_brute_force(frame):
    rows = [(i, t) for i, t in enumerate(EDGES * 8)] + [(None, "no id here"), (None, None), (5, "again"), (5, "again")]
    for unit in ("token", "char"):
        got = infill.restore(infill.transform(frame(rows), unit=unit)).collect()
        assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted((brute(i, t, unit) for i, t in rows), key=str)
        assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
        assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_query_over_the_fixture(spark, texts):
    got = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*b[:5], sha(b[5]), sha(t or "")) for b, (_, t) in ((brute(i, t), (i, t)) for i, t in texts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exception_index_goes_both_ways():
    for text in EDGES[1:]:
        index = infill.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
        chars = np.arange(min(len(text), 3100) + 1)
        cuts = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text[:3100]]))).astype(np.int64)
        assert (index.to_bytes(chars) == cuts).all() and (index.to_chars(cuts) == chars).all()
        assert index.chars == len(text) and len(index.at) == sum(ord(c) > 127 for c in text)


def test_empty_table_and_unit(frame):
    assert infill.restore(infill.transform(frame([]))).collect() == []
    with pytest.raises(ValueError):
        infill.transform(frame([]), unit="byte")
