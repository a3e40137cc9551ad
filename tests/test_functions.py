"""Column functions on hand rows (FIXTURES §3) and properties."""

import random
import time

import pytest
from pyspark.sql import functions as F



from codeshift.operators.codemetrics import classify_lines
from codeshift.functions import (complexity_profile, cyclomatic_complexity, decision_points, edit_distance,
                                 edit_similarity, escape_whitespace, fenced_blocks, line_profile,
                                 ndiff_distance, py_strip, python_raw_profile, run_command,
                                 run_distance, syntactic_similarity, unescape_whitespace)
from codeshift.functions.header import header_fields
from codeshift.operators.extract import merge_answer_blocks

from .rules import levenshtein


def one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


@pytest.mark.parametrize("code, expected", [
    ("", dict(LOC=0, comment=0, blank=1, comment_per_LOC=-1.0)),
    ("a b\n// c\n\n/* d */", dict(LOC=1, comment=2, blank=1, chars=3, tokens=2, comment_per_LOC=2.0)),
    ("/* a\n\nb\nc */\nd", dict(LOC=1, comment=3, blank=1)),
    ("x = 1; /* t */", dict(LOC=0, comment=1)),
    ("/* a\n// b */\nc", dict(LOC=0, comment=3)),
])
def test_line_profile_hand_rows(spark, code, expected):
    r = one(spark, [(code,)], "code string", line_profile("code").alias("p"))[0]["p"]
    for k, v in expected.items():
        assert r[k] == v, (k, r)


def test_line_profile_is_the_classes_counted(spark):
    """In-row fold against line classes from a window over the exploded lines."""
    rnd = random.Random(5)
    parts = ["ab", " ", "/", "*", "\t", "//", "/*", "*/", "  ", "\r", "é", "\n", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, code string")
    counted = classify_lines(df, ["id"], "code").groupBy("id").agg(
        *[F.count_if(F.col("line_class") == c).cast("int").alias(n) for c, n in (("loc", "LOC"), ("comment", "comment"), ("blank", "blank"))],
        F.sum("chars").cast("int").alias("chars"))
    profiled = df.select("id", line_profile("code").alias("p")).select("id", "p.LOC", "p.comment", "p.blank", "p.chars")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, profiled.collect()))


def test_strip_is_python_strip(spark):
    texts = ["  a  ", "\t\x0bb\x1c\x85 ", "　c ", "d\r\n", "", " "]
    got = [r[0] for r in one(spark, [(t,) for t in texts], "t string", py_strip("t"))]
    assert got == [t.strip() for t in texts]


@pytest.mark.parametrize("a, b, d", [("kitten", "sitting", 3), ("abcdefgh", "ghabcdef", 4)])
def test_ndiff_distance_hand_rows(spark, a, b, d):
    r = one(spark, [(a, b)], "a string, b string", ndiff_distance("a", "b").alias("d"),
            syntactic_similarity("a", "b").alias("s"))[0]
    assert r["d"] == d
    if a == "abcdefgh":
        assert r["s"] == 0.5


def test_ndiff_at_least_levenshtein(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(40):
        a = "".join(rnd.choice("abc \n") for _ in range(rnd.randint(0, 30)))
        b = "".join(rnd.choice("abcd \n") for _ in range(rnd.randint(0, 30)))
        rows.append((a, b))
    got = one(spark, rows, "a string, b string", "a", "b", ndiff_distance("a", "b").alias("n"),
              edit_distance("a", "b").alias("l"))
    for r in got:
        assert r["l"] == levenshtein(r["a"], r["b"])
        assert r["n"] >= r["l"]
        assert r["n"] == run_distance(r["a"], r["b"])


def test_edit_similarity_empty_is_null(spark):
    r = one(spark, [("", ""), ("ab", "ab"), ("ab", "")], "a string, b string",
            edit_similarity("a", "b").alias("s"))
    assert [x["s"] for x in r] == [None, 1.0, 0.0]


def test_fenced_blocks_and_merge(spark):
    text = "x```csharp\na\nb```y```c```z```"
    r = one(spark, [(text,), ("only ```open",)], "t string", fenced_blocks("t").alias("b"),
            merge_answer_blocks("t").alias("m"))
    assert r[0]["b"] == ["csharp\na\nb", "c"]
    assert r[0]["m"] == "\na\nb\nc"
    assert r[1]["m"] == ""


def test_run_command(spark):
    r = one(spark, [("C#",), ("c++",), ("python",), (None,)], "l string", run_command("l").alias("c"))
    assert [x["c"] for x in r] == ["dotnet build", "make", "", ""]


def test_unescape_and_round_trip(spark):
    r = one(spark, [("a\\nb",), ("x\ty\nz",)], "t string", unescape_whitespace("t").alias("u"),
            unescape_whitespace(escape_whitespace("t")).alias("rt"))
    assert r[0]["u"] == "a\nb"
    assert r[1]["rt"] == "x\ty\nz"


def test_header_fields(spark):
    block = "\n // src/a.cs\n // 12/30\n // https://x.org/o/repo9\n // C#\nvoid F() {\n}\n\n"
    h = header_fields("b")
    r = one(spark, [(block,), ("\n // only",)], "b string", *[v.alias(k) for k, v in h.items()])
    assert r[0]["path_to_snippet"] == "src/a.cs"
    assert (r[0]["snippet_line_start"], r[0]["snippet_line_end"]) == (12, 30)
    assert r[0]["repo_name"] == "repo9" and r[0]["repo_url"] == "https://x.org/o/repo9.git"
    assert r[0]["run_command"] == "dotnet build"
    assert r[0]["snippet_func_name"] == "void F() {"
    assert r[0]["original_code"] == "void F() {\n}"
    assert r[1]["snippet_line_start"] is None and r[1]["language"] is None


def test_complexity(spark):
    code = 'int F(int a) {\n  if (a > 0 && a < 9) { return 1; } // if\n  "if while";\n  for (;;) {}\n}'
    r = one(spark, [(code,), ("if and or while prose",)], "c string",
            decision_points("c").alias("d"), cyclomatic_complexity("c").alias("cc"))
    assert r[0]["d"] == 3 and r[0]["cc"] == 4
    assert r[1]["cc"] is None


def test_python_raw_profile(spark):
    trailing = "x = 1  # why\ny = '#'\nz = \"a \\\" # b\"  # c"
    r = one(spark, [(trailing,)], "c string", python_raw_profile("c").alias("p"))[0]["p"]
    assert (r["loc"], r["sloc"], r["comments"], r["blank"]) == (3, 3, 2, 0)
    r = one(spark, [("# c\n\nx = 1\n  # d",)], "c string", python_raw_profile("c").alias("p"))[0]["p"]
    assert (r["loc"], r["sloc"], r["comments"], r["blank"]) == (4, 1, 2, 1)


@pytest.mark.parametrize("a, b, d", [
    ("", "", 0), ("same", "same", 0), ("", "abc", 3), ("abc", "", 3),
    ("abc", "xyz", 3),               # one stretch: three out, three in
    ("abcd", "abXcd", 1),            # one in
    ("abcd", "ad", 2),               # two out
    ("abcd", "aXYd", 2),             # two out, two in, one stretch
    ("abcd", "aXcY", 2),             # two stretches of one out, one in
    ("aaXbb", "aabb", 1), ("ab\ncd", "ab cd", 1),
])
def test_run_distance_by_hand(a, b, d):
    assert run_distance(a, b) == d


def test_run_distance_properties():
    rnd = random.Random(11)
    for _ in range(400):
        alpha = rnd.choice(["ab", "abc \n", "abcdefg \t", "xyz", "aaaab "])
        a = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, rnd.choice([10, 60, 300]))))
        b = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, rnd.choice([10, 60, 300]))))
        d = run_distance(a, b)
        assert max(abs(len(a) - len(b)), levenshtein(a, b)) <= d <= len(a) + len(b)
        assert (d == 0) == (a == b)
        disjoint = b.translate({ord(c): ord(c) + 1000 for c in b})
        assert run_distance(a, disjoint) == max(len(a), len(b))


@pytest.mark.parametrize("text", ['int f(int a) {"' + "a" * 1_000_000 + '"; if (x) }', 'int f(int a) {"' + "\\n" * 500_000 + '"; if (x) }',
                                  "a" * 1_000_000, "a(" * 300_000, "/*" * 300_000, '"' * 1_000_001, "int f() {" + "if (a) " * 100_000])
def test_complexity_of_long_texts(spark, text):
    """No recursion and no backtracking on megabyte literals, names and comments."""
    start = time.time()
    p = one(spark, [(text,)], "c string", complexity_profile("c").alias("p"))[0]["p"]
    assert time.time() - start < 20
    if text.startswith('int f(int a) {"'):
        assert p["complexity"] == 2


@pytest.mark.parametrize("code, want", [
    ("if (a) { b(); }", None),                                     # a statement head is no function
    ("int f(int a) { if (a && b) {} }", 3),
    ("x = 1; int f() { while (a) {} } int g() { if (b || c) {} }", 2),   # the first function only
    ("f(a) => a ? 1 : 2", 2), ("int f() { /* if (a) }", 1), ('int f() { s = "if"; // if\n case 1: }', 2), ("", None), (None, None),
])
def test_complexity_of_the_first_function(spark, code, want):
    assert one(spark, [(code,)], "c string", cyclomatic_complexity("c").alias("v"))[0]["v"] == want


def test_edit_distance_by_bands(spark):
    """Equal to the textbook distance however many bands the search needs."""
    rnd = random.Random(6)
    rows = [(None, "a"), ("a", None), (None, None), ("", ""), ("", "abc"), ("é", "e"), ("日本語", "日本")]
    for n, changes in ((40, 3), (200, 10), (300, 120), (250, 250), (600, 1)):
        a = [rnd.choice("abcdé ") for _ in range(n)]
        b = list(a)
        for _ in range(changes):
            b[rnd.randrange(len(b))] = rnd.choice(["", "x", "yz"])
        rows.append(("".join(a), "".join(b)))
        rows.append(("".join(a), "".join(rnd.choice("xyz") for _ in range(n // 2))))
    got = one(spark, rows, "a string, b string", "a", "b", edit_distance("a", "b").alias("d"))
    for r in got:
        assert r["d"] == (None if r["a"] is None or r["b"] is None else levenshtein(r["a"], r["b"])), r
