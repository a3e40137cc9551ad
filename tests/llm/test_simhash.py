import random

import xxhash

from codeshift.llm import graph, simhash


def fp(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, radius=2):
    """Union of all pairs within the radius."""
    label = list(range(len(items)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if bin(items[i] ^ items[j]).count("1") <= radius:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def brute(rows):
    f = [fp(t) for _, t in rows]
    root = groups(f)
    out = []
    for (i, _), h, r in zip(rows, f, root):
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None]
        out.append((i, f"{h:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def near(frame, rows, **kw):
    got = simhash.near_groups(frame(rows), **kw).select("doc_id", simhash.hex16("fp"), "component_id").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_brute_force(frame, texts):
    edges = [(1000, None), (1001, ""), (1002, "  \n"), (None, "One Two"), (1003, "one two"), (None, None),
             (1004, "É one two three"), (1004, "É one two three"), (1005, "a b c " * 30000)]
    rows = texts + edges
    assert near(frame, rows) == brute(rows)


def test_every_close_pair_meets_in_a_table():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    assert all(bin(m).count("1") >= 36 for m in masks)


def test_small_and_large_buckets_agree(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    items = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.choice((0, 1, 1, 2, 3)))) for b in base for _ in range(60)})
    fps = spark.createDataFrame([(simhash._signed(x),) for x in items], "fp long")
    want = groups(items)
    want = {frozenset(simhash._signed(items[k]) for k in range(len(items)) if want[k] == r) for r in set(want)}
    for bucket in (2, 10, 10000):
        edges = simhash.links(fps, bucket=bucket)
        assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 2 for r in edges.collect())
        found = {}
        for r in graph.components(edges).collect():
            found.setdefault(r.root, set()).add(r.node)
        alone = {simhash._signed(x) for x in items} - {n for s in found.values() for n in s}
        assert {frozenset(s) for s in found.values()} | {frozenset([x]) for x in alone} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(-5, -7), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, -5: -7, -7: -7}


def test_drop_near_copies_and_empty(frame):
    long = " ".join(f"w{i}" for i in range(400))
    f = frame([(3, long), (1, long.upper()), (2, "entirely different words here"), (9, long)])
    left = simhash.drop_near_copies(f)
    assert left.columns == f.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert near(frame, []) == []


def test_drop_near_copies_leaves_one_row_a_group(frame):
    one, two = (" ".join(f"{c}{i}" for i in range(400)) for c in "vw")
    rows = [(3, one), (3, one), (3, one.upper()), (5, one), (None, two), (None, two), (None, two.upper()), (3, "third text here")]
    left = simhash.drop_near_copies(frame(rows)).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in left) == [(0, two), (3, "third text here"), (3, one)]
