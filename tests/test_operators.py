"""DataFrame operators on hand rows (FIXTURES §3) and brute-force fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeshift.operators import extract as ex
from codeshift.operators import normalize as nz
from codeshift.operators import outcomes as oc
from codeshift.operators import reports as rp
from codeshift.operators import sessions as ss
from codeshift.operators.codemetrics import classify_lines
from codeshift.operators.columns import feature_order, label_prompts
from codeshift.operators.ordinals import global_rank, running_total
from codeshift.sources import files as src

from codeshift.functions import line_profile


def test_classify_lines_matches_profile(spark):
    rnd = random.Random(3)
    parts = ["a b", "// x", "/* y", "z */", "/* w */", "", "  ", "q */", "// k */"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(1, 15))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, code string")
    profiles = {r["id"]: r["p"] for r in df.select("id", line_profile("code").alias("p")).collect()}
    got = (classify_lines(df, ["id"], "code").groupBy("id")
           .agg(F.count_if(F.col("line_class") == "loc").alias("LOC"),
                F.count_if(F.col("line_class") == "comment").alias("comment"),
                F.count_if(F.col("line_class") == "blank").alias("blank"),
                F.sum("chars").alias("chars")).collect())
    for r in got:
        p = profiles[r["id"]]
        assert (r["LOC"], r["comment"], r["blank"], r["chars"]) == (p["LOC"], p["comment"], p["blank"], p["chars"])


def _messages(spark, rows):
    return spark.createDataFrame(rows, "session_id long, idx long, role string, content string, prompt string")


def test_pairs_and_zip(spark):
    rows = [
        (1, 0, "system", "sys", ""),
        (1, 1, "user", "```A```", "p1"),
        (1, 2, "assistant", "```csharp\nX```", ""),
        (1, 3, "user", "```B``` and ```C```", "p2"),   # two user blocks: shifts the zip
        (1, 4, "assistant", "no fence", ""),
        (1, 5, "user", "```D```", "p3"),
        (1, 6, "assistant", "```Y``` ```Z```", ""),
        (1, 7, "user", "trailing", "p4"),
    ]
    m = _messages(spark, rows)
    pairs = ex.extract_pairs(m).orderBy("idx").collect()
    assert [(r["idx"], r["original_block"], r["updated_code"]) for r in pairs] == [
        (1, "A", "\nX"), (5, "D", "Y\nZ")]
    z = ex.zip_pairs(m).orderBy("pair_ord").collect()
    # answered turns 1 and 5; user blocks of answered turns: A, D -> zip A/X, D/Y Z
    assert [(r["original_block"], r["updated_code"]) for r in z] == [("A", "\nX"), ("D", "Y\nZ")]
    s = ex.extraction_summary(m).collect()[0]
    assert (s["n_user_blocks"], s["n_answer_blocks"], s["n_skipped"]) == (2, 2, 2)


def test_zip_pairs_shift(spark):
    rows = [(2, 1, "user", "```A``` ```B```", "p"), (2, 2, "assistant", "```X```", ""),
            (2, 3, "user", "```C```", "q"), (2, 4, "assistant", "```Y```", "")]
    z = ex.zip_pairs(_messages(spark, rows)).orderBy("pair_ord").collect()
    assert [(r["original_block"], r["updated_code"]) for r in z] == [("A", "X"), ("B", "Y")]


def test_running_total_brute_force(spark):
    rnd = random.Random(1)
    rows = [(g, i, rnd.randint(0, 5)) for g in range(4) for i in range(rnd.randint(1, 50))]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    got = {(r["g"], r["i"]): r["acc"] for r in running_total(df, ["g"], "i", "v", "acc", chunk=7).collect()}
    for g, i, _ in rows:
        assert got[(g, i)] == sum(v for gg, ii, v in rows if gg == g and ii < i)


def test_global_rank(spark):
    keys = random.Random(5).sample(range(10_000), 300)
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    got = {r["k"]: r["rk"] for r in global_rank(df, ["k"], "rk", partitions=5).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_splice_lines(spark):
    """By repository and path; lines of the update as ``splitlines`` gives them."""
    files = spark.createDataFrame([("r", "f", "a\nb\nc\nd"), ("other", "f", "1\n2\n3\n4")], "repo_name string, path string, text string")
    cases = [("r", 1, 2, "X\nY", "a\nX\nY\nd"), ("r", None, 2, "Z", "a\nb\nc\nd"), ("r", 9, 12, "Q", "a\nb\nc\nd\nQ"),
             ("r", 1, 2, "", "a\nd"), ("r", 1, 2, "X\nY\n", "a\nX\nY\nd"), ("r", 1, 2, "\n", "a\n\nd"), ("r", 1, 1, "X\r\nY\r\n", "a\nX\nY\nc\nd"),
             ("other", 0, 0, "X", "X\n2\n3\n4"), ("none", 0, 0, "X", None)]
    recs = spark.createDataFrame([(1, i, repo, "f", lo, hi, code) for i, (repo, lo, hi, code, _) in enumerate(cases)],
                                 "session_id long, idx long, repo_name string, path_to_snippet string, snippet_line_start int, "
                                 "snippet_line_end int, updated_code string")
    got = {r["idx"]: r["spliced_text"] for r in oc.splice_lines(files, recs).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases) if c[-1] is not None}


def test_build_outcomes(spark):
    o = spark.createDataFrame([(1, 1, 1, "Build succeeded"), (1, 3, 0, "Build succeeded"), (3, 1, 0, "ok")],
                              "session_id long, idx long, exit_code int, log string")
    classified = oc.classify_build_log(o)
    got = {(r["session_id"], r["idx"]): (r["build_success"], r["test_success"]) for r in classified.collect()}
    assert got == {(1, 1): (0, ""), (1, 3): (1, ""), (3, 1): (None, "")}
    s = oc.build_summary(classified).collect()[0]
    assert (s["builds_succeeded"], s["builds_failed"], s["builds_unknown"]) == (1, 1, 1)
    records = spark.createDataFrame([(1, 1), (1, 3), (1, 5), (3, 1)], "session_id long, idx long")
    attached = {(r["session_id"], r["idx"]): r["build_success"] for r in oc.attach_build_outcome(records, classified).collect()}
    assert attached == {(1, 1): 0, (1, 3): 1, (1, 5): None, (3, 1): None}
    with pytest.raises(Exception, match="more than one build outcome"):
        oc.attach_build_outcome(records, classified.unionByName(classified)).collect()


def test_every_prompt_stays_in_the_reports(spark):
    """More prompts than published labels: the others are their own label."""
    from codeshift.operators.reports import score_records
    df = spark.createDataFrame([(k, 0, f"prompt {k % 12:02d}", "r", 1.0) for k in range(48)],
                               "session_id long, idx long, prompt string, repo_name string, x double")
    got = score_records(df, with_group_stats=False).collect()
    assert len({r["prompt_id"] for r in got}) == 12 and all(r["pass_rate"] == 100 for r in got)
    assert {r["prompt_id"] for r in got if r["prompt_ord"] > 7} == {f"prompt {k:02d}" for k in range(8, 12)}
    own = score_records(df, with_group_stats=False, labels={11: "eleven"}).collect()
    assert {r["prompt_id"] for r in own if r["prompt_ord"] == 11} == {"eleven"}


def test_mapping_is_one_json_object(spark, tmp_path):
    import json

    from codeshift.sinks.files import write_prompt_mapping
    words = {f'say "{k}"\\ é\n{k}': k for k in range(50)}
    d = spark.createDataFrame([(p, k) for p, k in words.items()], "prompt string, prompt_ord int").repartition(7)
    write_prompt_mapping(d, str(tmp_path / "m"))
    files = [p for p in (tmp_path / "m").iterdir() if p.suffix == ".txt"]
    assert len(files) == 1 and json.loads(files[0].read_text()) == words


def test_minmax_rules(spark):
    df = spark.createDataFrame([(0, 7), (5, 7), (10, 7)], "a int, k int")
    t = nz.minmax_normalize(df.select("a"))
    assert [r["a"] for r in t.orderBy("a").collect()] == [0.0, 0.0, 1.0]
    p = nz.minmax_normalize(df)  # k is constant: parity leaves every row unchanged
    assert sorted((r["a"], r["k"]) for r in p.collect()) == [(0.0, 7.0), (5.0, 7.0), (10.0, 7.0)]
    np_ = nz.minmax_normalize(df, parity=False, truncate=False)
    assert sorted(r["a"] for r in np_.collect()) == [0.0, 0.5, 1.0]


def test_zscore_matches_pandas(spark):
    rnd = random.Random(2)
    vals = [(rnd.uniform(-10, 10), rnd.uniform(0, 3)) for _ in range(50)]
    df = spark.createDataFrame(vals, "x double, y double")
    got = sorted((r["x"], r["y"]) for r in nz.zscore_normalize(df, truncate=False).collect())
    p = pd.DataFrame(vals, columns=["x", "y"])
    z = ((p - p.mean()) / p.std())
    want = sorted(zip(z["x"], z["y"]))
    for (a, b), (c, d) in zip(got, want):
        assert abs(a - c) < 1e-9 and abs(b - d) < 1e-9


def test_category_table_half_even(spark):
    rows = [(i, "k0" if i < 51 else f"k{1 + i % 7}", 1, 1, 1, 1, -1, -1) for i in range(51 + 70)]
    df = spark.createDataFrame(rows, "idx long, key string, original_LOC int, updated_LOC int, "
                                     "original_comment int, updated_comment int, "
                                     "original_cyclomatic_complexity int, updated_cyclomatic_complexity int")
    t = {r["key"]: r for r in rp.category_table(df, "key", 480).collect()}
    assert t["k0"]["pass_rate"] == 0.8 and t["k0"]["num_elements"] == 51
    assert sum(r["num_elements"] for r in t.values()) == len(rows)


def test_mean_of_ratios_vs_ratio_of_means(spark):
    cols = ["LOC", "comment", "blank", "chars", "tokens", "comment_per_LOC", "levenshtein_distance",
            "syntactic_similarity", "cyclomatic_complexity"]
    schema = ("session_id long, idx long, repo_name string, prompt_id string, original_code string, pass_rate double, "
              + ", ".join(f"original_{c} double, updated_{c} double" for c in cols))
    mk = lambda i, o, u: (1, i, "r", "p", "code", 50.0, *[x for _ in cols for x in (float(o), float(u))])
    df = spark.createDataFrame([mk(0, 1, 2), mk(1, 3, 3)], schema)
    i7 = rp.category_pct_change(df, "prompt_id", 2).collect()[0]
    assert i7["LOC"] == 50.0
    i11 = {r["row_label"]: r for r in rp.prompt_table_pct(df).collect()}
    assert i11["p"]["LOC"] == 25.0


def test_label_prompts_missing_id(spark):
    df = spark.createDataFrame([(0,), (7,), (9,)], "prompt_ord int")
    got = [r["prompt_id"] for r in label_prompts(df, labels={0: "a"}).orderBy("prompt_ord").collect()]
    assert got == ["a", None, None]


def test_feature_order():
    assert feature_order(["pass_rate", "original_LOC", "updated_LOC", "original_blank"]) == [
        "original_LOC", "updated_LOC", "original_blank", "pass_rate"]


def test_cross_prompts_and_requests(spark):
    sn = spark.createDataFrame([(0, "s0"), (1, "s1")], "snippet_ord long, snippet string")
    pr = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "prompt_ord int, prompt string")
    c = ss.cross_prompts(sn, pr).orderBy("ord").collect()
    assert [(r["snippet"], r["prompt"], r["ord"]) for r in c] == [
        ("s0", "p0", 0), ("s0", "p1", 1), ("s0", "p2", 2), ("s1", "p0", 3), ("s1", "p1", 4), ("s1", "p2", 5)]
    rows = [(1, 0, "system", "S", ""), (1, 1, "user", "u1", "p"), (1, 2, "assistant", "a1", ""),
            (1, 3, "user", "u2", "p")]
    req = ss.build_requests(_messages(spark, rows)).orderBy("request_idx", "pos").collect()
    assert [(r["request_idx"], r["pos"]) for r in req] == [(1, 0), (1, 1), (3, 0), (3, 1), (3, 2), (3, 3)]
    ind = ss.context_independent(_messages(spark, rows)).orderBy("request_idx", "pos").collect()
    assert [(r["request_idx"], r["role"]) for r in ind] == [(1, "system"), (1, "user"), (3, "system"), (3, "user")]


def test_parse_session_markdown(spark):
    text = "intro\n## User \n```\ncode a\n```\nFix it.\n\n## User \n```\ncode b\n```\nRewrite it.\n"
    df = spark.createDataFrame([("f", text)], "f string, text string")
    got = src.parse_session_markdown(df).orderBy("idx").collect()
    assert [r["role"] for r in got] == ["system", "user", "user"]
    assert got[1]["content"] == "```\n code a\n ```\n Fix it.\n \n"
    assert got[1]["prompt"] == "Fix it.\n" and got[2]["prompt"] == "Rewrite it.\n"
    assert got[2]["content"] == "```\n code b\n ```\n Rewrite it.\n"


def test_parse_chat_json(spark):
    js = '[{"role":"system","content":"s"},{"role":"user","content":"u","prompt":"p"},{"role":"assistant","content":"a"}]'
    got = src.parse_chat_json(spark.createDataFrame([("f", js)], "f string, text string")).orderBy("idx").collect()
    assert [(r["idx"], r["role"], r["prompt"]) for r in got] == [(0, "system", None), (1, "user", "p"), (2, "assistant", None)]


def test_latest_run(spark):
    names = spark.createDataFrame([("code_snippets_2024-06-03_17-28_coder-7b-it.json",),
                                   ("code_snippets_2024-06-03_18-01_coder-7b-it.json",),
                                   ("other.json",)], "file_name string")
    r = src.latest_run(names, "code_snippets", "coder-7b-it").collect()
    assert [x["file_name"] for x in r] == ["code_snippets_2024-06-03_18-01_coder-7b-it.json"]


def test_prompts_parse(spark):
    text = "Prompts to test:\n\n- first  \n\n-----\n\n- second\n"
    got = src.parse_prompts(spark.createDataFrame([("f", text)], "f string, text string")).collect()
    assert [(r["prompt_ord"], r["prompt"]) for r in got] == [(0, "first"), (1, "second")]


def test_chat_json_round_trip_edges(spark, tmp_path):
    from codeshift.sinks.files import write_chat_json
    rows = [(1, 0, "user", "only", "p"), (2, 0, "system", 's"q', ""), (2, 1, "user", "a\nb\t[c]", "p"),
            (2, 2, "assistant", "x,]", "")]
    for layout in ("files", "lines"):
        out = str(tmp_path / layout)
        write_chat_json(_messages(spark, rows), out, model="m", run_ts="2024-01-01_10-00", layout=layout)
        back = src.scan_chat_json(spark, out, layout=layout).select(F.col("session_id").cast("long"), F.col("idx").cast("long"),
                                                                    "role", "content", "prompt")
        assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def _data_files(path):
    import pathlib
    return [f for f in pathlib.Path(path).rglob("part-*") if "_sessions" not in f.parts]


def test_transcript_lines_are_as_many_files_as_tasks(spark, tmp_path):
    """File count does not follow the sessions; places count from 0 whatever the index."""
    from codeshift.sinks.files import write_chat_json
    rows = [(s, 7 * i + s, "user", f"{s}/{i}", None) for s in range(200) for i in range(3)]
    rows += [(1000, 5 * i, "user", str(i), None) for i in range(3000)]
    out = str(tmp_path / "runs")
    write_chat_json(_messages(spark, rows), out, model="m", run_ts="2024-01-01_10-00")
    assert 0 < len(_data_files(out)) <= 8
    back = src.scan_chat_json(spark, out).collect()
    want = {(str(s), (i - s) // 7 if s < 1000 else i // 5): c for s, i, _, c, _ in rows}
    assert {(r["session_id"], r["idx"]): r["content"] for r in back} == want and len(back) == len(rows)
    assert {(r["model"], r["run_ts"]) for r in back} == {("m", "2024-01-01_10-00")}


def test_session_turns_parse_like_the_file(spark, tmp_path):
    from codeshift.sinks.files import write_session_markdown
    turns = [(s, o, f"\n## User \n```\ncode {o}{x}\n```\nprompt {o}\n") for s in (1, 2, 3) for o, x in ((0, ""), (4, "\n  more"), (9, "\n\n"))]
    turns += [(4, 2, "\n## User \n```\na\n## User x\nb\n```\np\n"), (4, 3, "\n## User \n```\nz\n```\nlast\n")]
    df = spark.createDataFrame(turns, "session long, ord long, text string")
    got = []
    for layout in ("files", "lines"):
        out = str(tmp_path / layout)
        write_session_markdown(df, out, layout=layout)
        back = src.scan_session_markdown(spark, out, layout=layout)
        got.append(sorted(tuple(r) for r in back.select(F.col("session").cast("long"), "idx", "role", "content", "prompt").na.fill("").collect()))
    assert got[0] == got[1] and len(got[0]) == 3 * 4 + 4


def test_choosing_a_run_reads_no_text(spark, tmp_path):
    d = tmp_path / "flat"
    d.mkdir()
    for n in ("a_b_2024-01-01_10-00_m.json", "a_b_2024-01-02_10-00_m.json"):
        (d / n).write_text("[]")
    names = src.list_files(spark, str(d))
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and names.count() == 2
    chosen = src.read_chosen(spark, str(d), names.where(F.col("file_name").contains("01-02")))
    assert [r["file_name"] for r in chosen.collect()] == ["a_b_2024-01-02_10-00_m.json"]
    assert src.read_chosen(spark, str(d), names.limit(0)).collect() == []


def test_transcript_turns_in_array(spark):
    from codeshift.streaming.transcripts import records_from_files
    js = ('[{"role":"system","content":"s"},{"role":"user","content":"```\\n // a.cs\\n // 1/2\\n // u/r\\n // c#\\nx;\\n```","prompt":"p"},'
          '{"role":"assistant","content":"```y;```"},{"role":"user","content":"```z```","prompt":"q"}]')
    files = spark.createDataFrame([(js, "/d/session_id=7/f.txt")], "value string, file_path string")
    r = records_from_files(files, F.lit("7")).collect()
    assert len(r) == 1
    assert (r[0]["idx"], r[0]["repo_name"], r[0]["updated_code"], r[0]["original_code"]) == (1, "r", "y;", "x;")


def test_dictionary_by_first_appearance(spark):
    from codeshift.operators.columns import encode_prompts
    from codeshift.operators.ordinals import first_appearance_index
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 30), i, f"p{rnd.randint(0, 40)}") for i in range(400)]
    df = spark.createDataFrame(rows, "session_id long, idx long, prompt string")
    got = first_appearance_index(df, "prompt", ["session_id", "idx"], "o")
    assert got.schema["o"].dataType.simpleString() == "bigint"
    first = {}
    for s, i, p in sorted(rows):
        first.setdefault(p, (s, i))
    want = {p: k for k, p in enumerate(sorted(first, key=lambda p: (first[p], p)))}
    assert {r["prompt"]: r["o"] for r in got.collect()} == want
    assert {(r["session_id"], r["idx"]): r["prompt_ord"] for r in encode_prompts(df).collect()} == {(s, i): want[p] for s, i, p in rows}


def test_hot_session_brute_force(spark):
    """One session holds about half of all messages; results must equal a
    plain-Python positional pairing and zip."""
    import re
    from codeshift.operators import ordinals
    rnd = random.Random(4)
    rows = []
    for sid, n in [(0, 1200)] + [(s, rnd.randint(2, 9)) for s in range(1, 150)]:
        for i in range(n):
            role = "user" if i % 2 == 0 else "assistant"
            if role == "user":
                k = rnd.choice([1, 1, 2])
                content = " ".join(f"```u{sid}_{i}_{b}```" for b in range(k))
            else:
                content = rnd.choice([f"```a{sid}_{i}```", "no code", f"```x``` ```y{i}```"])
            rows.append((sid, i, role, content, f"p{i % 3}"))
    m = _messages(spark, rows)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want_pairs, want_zip = set(), set()
    for sid, msgs in by.items():
        msgs.sort(key=lambda r: r[1])
        ub, ans = [], []
        for u, a in zip(msgs, msgs[1:]):
            if u[2] == "user" and a[2] == "assistant" and "```" in a[3]:
                blocks = re.findall(r"```(.*?)```", u[3], re.S)
                merged = "\n".join(re.findall(r"```(.*?)```", a[3], re.S))
                want_pairs.add((sid, u[1], blocks[0], merged))
                ub += blocks
                ans.append((u[1], merged))
        for o, (idx, merged) in zip(ub, ans):
            want_zip.add((sid, idx, o, merged))
    got_pairs = {(r["session_id"], r["idx"], r["original_block"], r["updated_code"])
                 for r in ex.extract_pairs(m).collect()}
    assert got_pairs == want_pairs
    orig = ordinals.running_totals
    ordinals_chunk = lambda *a, **k: orig(*a, **{**k, "chunk": 64})
    ex.running_totals = ordinals_chunk  # many chunks inside the hot session
    try:
        got_zip = {(r["session_id"], r["idx"], r["original_block"], r["updated_code"])
                   for r in ex.zip_pairs(m).collect()}
    finally:
        ex.running_totals = orig
    assert got_zip == want_zip
    s = {r["session_id"]: r for r in ex.extraction_summary(m).collect()}
    assert s[0]["n_answer_blocks"] == sum(1 for p in want_pairs if p[0] == 0)


def test_pairing_spreads_a_hot_session(spark):
    """Rows per task after the pairing join: a session with half of all
    messages spreads over tasks; a lead window would put it in one task."""
    from pyspark.sql import Window
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", "```c```", "p") for i in range(4000)]
    rows += [(s, i, "user" if i % 2 == 0 else "assistant", "```c```", "p") for s in range(1, 1001) for i in range(4)]
    m = _messages(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        def share(df, used):
            # Count a computed column so the window / join is not pruned away.
            c = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(used).alias("n")).collect()]
            return max(c) / sum(c)
        joined = ex.pair_turns(m)
        w = Window.partitionBy("session_id").orderBy("idx")
        windowed = m.withColumn("next", F.lead("content").over(w)).filter(F.col("role") == "user")
        assert share(windowed, "next") >= 0.5          # the hot session lands in one task
        assert share(joined, "answer_content") < 0.25  # the unique (session_id, idx) key spreads it
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")


def test_running_totals_spread_a_hot_session(spark):
    from pyspark.sql import Window
    from codeshift.operators.ordinals import running_totals
    rows = [(0, i, 1) for i in range(4000)] + [(s, i, 1) for s in range(1, 1001) for i in range(4)]
    df = spark.createDataFrame(rows, "g long, i long, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        def share(d, used):
            c = [r["n"] for r in d.groupBy(F.spark_partition_id().alias("p")).agg(F.count(used).alias("n")).collect()]
            return max(c) / sum(c)
        plain = df.withColumn("acc", F.sum("v").over(Window.partitionBy("g").orderBy("i")))
        chunked = running_totals(df, ["g"], "i", {"v": "acc"}, chunk=256)
        assert share(plain, "acc") >= 0.5
        assert share(chunked, "acc") < 0.3
        got = {(r["g"], r["i"]): r["acc"] for r in chunked.filter(F.col("g") == 0).collect()}
        assert all(got[(0, i)] == i for i in range(4000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_requests_in_two_shuffles(spark):
    """C6 is C4 for short sessions and C5 for long ones; two shuffles, and none
    of them by anything but the session."""
    rnd = random.Random(8)
    rows = []
    for sid in range(40):
        roles = [rnd.choice(["system", "user", "assistant", "user"]) for _ in range(rnd.choice([0, 1, 3, 6, 9, 30]))]
        rows += [(sid, 3 * i + sid, r, f"{sid}.{i}", "") for i, r in enumerate(roles)]
    m = _messages(spark, rows)
    got = ss.build_requests(m)
    want = ss.context_cumulative(m, 5).withColumn("mode", F.lit("cumulative")).unionByName(
        ss.context_independent(m, 5).withColumn("mode", F.lit("independent")))
    assert got.columns == want.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(session_id") == plan.count("Exchange ") == 2, plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_classified_lines_without_a_shuffle(spark):
    """Long texts, where the state passes from one chunk of lines to the next."""
    rnd = random.Random(5)
    parts = ["x", "/* y", "z */", "/* w */", "", " ", "// k */", "/* q"]
    texts = ["\n".join(rnd.choice(parts[:4] * 3 + parts) for _ in range(n)) for n in (1, 255, 256, 257, 1500)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, code string")
    got = classify_lines(df, ["id"], "code")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    want = []
    for i, text in enumerate(texts[:-1]):
        inside = False
        for k, line in enumerate(text.split("\n")):
            s = line.strip()
            if not s:
                c = "blank"
            elif s.startswith("//"):
                c = "comment"
            elif s.startswith("/*"):
                c, inside = "comment", inside or not s.endswith("*/")
            elif s.endswith("*/"):
                c, inside = "comment", False
            else:
                c = "comment" if inside else "loc"
            want.append((i, k, line, c, len(s) if c == "loc" else 0))
    assert sorted(map(tuple, got.collect())) == want


def test_quantiles_over_ranges(spark):
    from codeshift.operators.ordinals import quantiles
    rnd = random.Random(11)
    cols = {"a": [rnd.gauss(0, 1) for _ in range(999)], "b": [1.0] * 999, "c": [float(rnd.randint(0, 3)) for _ in range(999)],
            "d": [None] * 999, "e": [None] * 998 + [4.0], "f": [rnd.random() if k % 3 else None for k in range(999)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, list(cols), fractions).first()
    for k, v in enumerate(cols.values()):
        want = pd.Series([x for x in v if x is not None], dtype="float64").quantile(fractions).tolist()
        assert [x if x is not None else float("nan") for x in got[f"_q{k}"]] == pytest.approx(want, nan_ok=True)
    plan = rp.describe(df, columns=["a", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_dear_pairs_are_dealt_by_cost(spark):
    from codeshift.operators.codemetrics import dealt_by_cost
    rnd = random.Random(2)
    sizes = [int(20 * rnd.paretovariate(1.2)) % 3000 + 1 for _ in range(4000)] + [3000] * 12
    df = spark.createDataFrame([(k, "a" * n, "b" * n) for k, n in enumerate(sizes)], "id int, x string, y string")
    dealt = dealt_by_cost(df, "x", "y", parts=6)
    load = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("x").cast("double") * F.length("y")).alias("cost"))
    costs = sorted(r["cost"] for r in load.collect())
    assert len(costs) == 6 and costs[-1] < 2 * costs[len(costs) // 2]
    assert sorted(r["id"] for r in dealt.collect()) == list(range(len(sizes))) and dealt.columns == df.columns


def test_group_columns_leave_wide_rows_in_place(spark):
    df = spark.createDataFrame([(f"r{k % 3}", f"p{k % 2}", k, float(k % 7)) for k in range(60)],
                               "repo_name string, prompt_id string, original_LOC int, updated_LOC double")
    for got in (rp.add_group_stats(df), rp.add_pass_rate(df, 10), nz.minmax_normalize(df, partition_by="repo_name")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan, plan
        assert got.count() == 60


def test_distinct_texts_by_digest(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), (None, "x"), ("a", "é"), ("a", None), ("a", None), ("b", "")]
    got = rp.distinct_texts(spark.createDataFrame(rows, "k string, t string"), ["k"], "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(set(rows), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and ", t#" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_pair_columns_order(spark):
    from codeshift.operators.columns import pair_columns
    df = spark.createDataFrame([(1,) * 8], "updated_b int, z int, original_a int, updated_a int, original_b int, updated_c int, a int, original_d int")
    assert pair_columns(df).columns == ["z", "updated_c", "a", "original_a", "updated_a", "original_b", "updated_b", "original_d"]
