import random
import re

from codeshift.llm import licenses


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = split(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


EDGES = [None, "", "MIT License", "MIT  license,mit LICENSE", "the mit license mit license.", "GNU General Public License v3",
         "apache-license apache licensed", "mit éa license", "été mit license", "permit license", "İ MIT\nLicense", "mit license " * 20000,
         "general public general public license"]


def test_base_against_brute_force(frame, texts):
    rows = list(enumerate(EDGES)) + [(None, "mit license"), (1, None)] + [(1000 + i, t) for i, t in texts]
    got = licenses.scan(frame(rows)).collect()
    key = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((str(r.doc_id), str(tuple(r[k] for k in key))) for r in got) == sorted((str(i), str(base(t))) for i, t in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    assert licenses.scan(frame([])).collect() == []


def longest(templates, words, end):
    """Longest suffix of words[:end] that occurs in a template."""
    for n in range(end, 0, -1):
        part = words[end - n:end]
        if any(t[i:i + n] == part for t in templates for i in range(len(t) - n + 1)):
            return n
    return 0


def test_matching_statistics_and_places():
    for seed in range(30):
        rng = random.Random(seed)
        word = lambda: rng.choice("abc").encode()
        templates = [[word() for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        a = licenses.Automaton([(str(k), b" ".join(t).decode()) for k, t in enumerate(templates)])
        words = [word() for _ in range(30)]
        ms = a.statistics([a.code.get(w, -1) for w in words])
        assert [n for n, _ in ms] == [longest(templates, words, e) for e in range(1, len(words) + 1)]
        for e, (n, state) in enumerate(ms, 1):
            part = words[e - n:e]
            want = {(k, i + n) for k, t in enumerate(templates) for i in range(len(t) - n + 1) if t[i:i + n] == part}
            assert not n or a.ends[state] == want


def test_template_words_run_by_run_is_the_whole_stream():
    a = licenses.Automaton(licenses.TEMPLATES)
    rng = random.Random(4)
    vocabulary = list(a.code) + [b"other"] * 10
    for _ in range(50):
        words = [rng.choice(vocabulary) for _ in range(60)]
        t = a.templates[rng.randrange(len(a.templates))][1]
        words[20:20] = t
        ms = a.statistics([a.code.get(w, -1) for w in words]) + [(0, 0)]
        want = [(k + 1 - n, n, v) for k, (n, v) in enumerate(ms[:-1]) if n >= licenses.LEAST and ms[k + 1][0] != n + 1]
        assert a.matches(words) == want


def test_spans(frame):
    mit, gpl = licenses.TEMPLATES[0][1], licenses.TEMPLATES[6][1]
    words = mit.split()
    changed = " ".join(w if i % 20 != 10 else "CHANGED" for i, w in enumerate(words))
    rows = [(1, "before it " + mit.upper() + " after"), (2, "/* " + changed + " */"), (3, " ".join(words[:20])), (4, mit + "\n\n" + gpl),
            (5, "Licensed under CC BY-NC 4.0."), (6, "plain text of no licence at all"), (7, (mit + " x ") * 40)]
    got = {r.doc_id: r for r in licenses.scan(frame(rows)).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4, 5, 6)] == ["mit", "mit", "", "gpl,mit", "cc-by-nc", ""]
    assert got[1].score == 1 and got[1].spans[0].first == 2 and got[1].spans[0].after == 2 + len(licenses.words_of(mit))
    assert 0.8 <= got[2].score < 1 and 0.2 < got[3].score < 0.5 and got[6].score == 0
    assert len(got[7].spans) == 40


def test_ten_megabytes_of_one_phrase():
    """One pass, however many places there are."""
    import time
    words = licenses.words_of("mit license " * 830_000)
    start = time.time()
    got = licenses.base_places(words)
    assert time.time() - start < 10 and len(got) == 830_000 and got[-1] == (2 * 829_999, "mit")
