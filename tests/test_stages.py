"""The three stages end to end on files derived from the smallest tables."""

import json
import os
from hashlib import sha512

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeshift.operators.codemetrics import assemble_records
from codeshift.operators.extract import extract_pairs
from codeshift.plans import records as P
from codeshift.plans import stages
from codeshift.sinks.files import write_chat_json
from codeshift.sources.files import list_files, read_chosen, scan_chat_json

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_sessions_stage(spark, tmp_path):
    snippets = str(tmp_path / "snippets")
    (P.snippets(spark, SF).select(F.concat(F.lit("snippet"), F.col("snippet_ord").cast("string")).alias("name"),
                                  F.col("snippet").alias("value"))
     .write.partitionBy("name").text(snippets))
    prompts = tmp_path / "prompts.md"
    prompts.write_text("Prompts to test:\n\n- Fix it.\n\n- Rewrite it. \n\n----\n\n- Refactor it.\n")
    out = str(tmp_path / "sessions")
    stages.sessions_stage(spark, snippets, str(prompts), out)
    back = spark.read.text(out, wholetext=True).collect()
    n_snippets = P.snippets(spark, SF).count()
    assert len(back) == n_snippets
    assert all(r["value"].count("## User") == 3 for r in back)
    assert all(r["value"].rstrip("\n").endswith("Refactor it.") for r in back)


def test_metrics_and_reports_stage(spark, tmp_path):
    # A written transcript is an array: messages are known by their place.
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("idx")) - 1
    msgs = P.messages(spark, SF).withColumn("idx", place.cast("long"))
    tdir = str(tmp_path / "transcripts")
    older = msgs.withColumn("content", F.upper("content"))
    write_chat_json(older, tdir, model="coder-7b-it", run_ts="2024-06-03_17-28")
    write_chat_json(msgs, tdir, model="coder-7b-it", run_ts="2024-06-04_09-05")
    rec_dir = str(tmp_path / "records")
    got = stages.metrics_stage(spark, tdir, rec_dir)
    want = assemble_records(extract_pairs(msgs))
    cols = want.columns
    want = want.withColumn("session_id", F.col("session_id").cast("string"))
    assert got.schema["session_id"].dataType.simpleString() == "string" and "n_user_blocks" in got.columns
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == \
        sorted(map(tuple, want.select(*cols).collect()), key=repr)

    out = str(tmp_path / "reports")
    design = msgs.filter(F.col("role") == "user").count()
    written = stages.reports_stage(spark, got, out, design, extended=True)
    table = spark.read.option("header", True).option("inferSchema", True).csv(written["category_prompt_id"])
    assert set(table.columns) >= {"prompt_id", "pass_rate", "og_LOC", "up_LOC", "num_elements"}
    assert table.agg(F.sum("num_elements")).first()[0] == got.count()
    summary = spark.read.option("header", True).csv(written["summary"])
    assert "og_cmnt/LOC" in summary.columns and summary.count() == 8
    mapping = json.loads(spark.read.text(written["prompt_mapping"], wholetext=True).first()[0])
    assert sorted(mapping.values()) == list(range(len(mapping)))
    for name in ("table_abs", "heatmap", "multibar"):
        assert spark.read.option("header", True).csv(written[name]).count() > 0


def test_metrics_stage_named_files(spark, tmp_path):
    d = tmp_path / "output"
    d.mkdir()
    block = "```\\n // src/a.cs\\n // 1/2\\n // https://x.org/o/rep\\n // c#\\nint x;\\n```"
    def chat(answer):
        return json.dumps([{"role": "system", "content": "s"},
                           {"role": "user", "content": block.replace("\\\\n", "\\n"), "prompt": "Fix it.\\n"},
                           {"role": "assistant", "content": answer}])
    (d / "code_snippets_2024-06-03_17-28_coder-7b-it.json").write_text(chat("```old```"))
    (d / "code_snippets_2024-06-04_09-15_coder-7b-it.json").write_text(chat("```new;```"))
    (d / "code_snippets_2024-06-05_10-00_coder-7b-it_test.json").write_text(chat("```test```"))
    (d / "other_snippets_2024-06-01_08-00_coder-7b-it.json").write_text(chat("```o```"))
    got = stages.metrics_stage(spark, str(d), str(tmp_path / "rec"), layout="names").collect()
    by = {r["session_id"]: r for r in got}
    assert set(by) == {"code_snippets", "other_snippets"}
    # The latest run counts, whatever its name says; leaving test runs out is on demand.
    assert by["code_snippets"]["updated_code"] == "test"
    kept = stages.latest_named_transcripts(spark, str(d), exclude_test=True)
    assert {r["content"] for r in kept.collect() if r["session_id"] == "code_snippets" and r["role"] == "assistant"} == {"```new;```"}
    (d / "code_snippets_2024-06-07_10-00_coder-latest.json").write_text(chat("```l```"))
    kept = stages.latest_named_transcripts(spark, str(d), exclude_test=True)
    assert "coder-latest" in {r["model"] for r in kept.collect()}
    assert by["code_snippets"]["repo_name"] == "rep" and by["code_snippets"]["original_code"] == "int x;"


def test_runs_are_chosen_by_part_of_a_model_name(spark, tmp_path):
    def run(text):
        return spark.createDataFrame([(s, i, "user", f"{text} {s}.{i}", "") for s in (1, 2) for i in (0, 1)],
                                     "session_id long, idx long, role string, content string, prompt string")
    for layout in ("lines", "files"):
        d = str(tmp_path / layout)
        write_chat_json(run("old"), d, model="coder-7b-it", run_ts="2024-06-03_17-28", layout=layout)
        write_chat_json(run("new").where("session_id = 1"), d, model="coder-7b-it", run_ts="2024-06-04_09-05", layout=layout)
        write_chat_json(run("big"), d, model="coder-13b", run_ts="2024-06-05_09-05", layout=layout)
        write_chat_json(run("other"), d, model="plain", run_ts="2024-06-06_09-05", layout=layout)
        got = {(r["model"], str(r["session_id"]), r["content"]) for r in stages.latest_transcripts(spark, d, "7b", layout).collect()}
        assert got == {("coder-7b-it", "1", "new 1.0"), ("coder-7b-it", "1", "new 1.1"), ("coder-7b-it", "2", "old 2.0"), ("coder-7b-it", "2", "old 2.1")}
        got = stages.latest_transcripts(spark, d, "coder", layout)
        assert {r["model"] for r in got.collect()} == {"coder-7b-it", "coder-13b"} and got.count() == 8
        assert stages.latest_transcripts(spark, d, "none", layout).count() == 0


def test_build_command(spark, tmp_path):
    records, outcomes, out = (str(tmp_path / n) for n in ("records", "outcomes", "out"))
    P.records(spark, SF).write.parquet(records)
    (P.records(spark, SF).select("session_id", "idx", F.when(F.col("idx") % 2 == 1, 0).otherwise(1).alias("exit_code"),
                                 F.lit("Build succeeded.").alias("log")).write.json(outcomes))
    stages.main(["build", records, outcomes, out, "--outcomes-format", "json"], spark)
    got = spark.read.parquet(out)
    assert got.count() == spark.read.parquet(records).count()
    assert {(r["idx"] % 2, r["build_success"]) for r in got.collect()} <= {(1, 1), (0, 0)}


def test_stage_tables_follow_their_input(spark, tmp_path):
    """A file rewritten inside a folder table makes the stage run again."""
    folder = tmp_path / "t.parquet"
    def put(value):
        spark.range(value, value + 1).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "new"))
        folder.mkdir(exist_ok=True)
        part, = (tmp_path / "new").glob("part-*.parquet")
        (folder / "part-0.parquet").write_bytes(part.read_bytes())
    def stage():
        return P.stage_output(spark, str(tmp_path), "follow", (), ("t",), lambda: spark.read.parquet(str(folder))).first()[0]
    put(5)
    first = stage()
    os.utime(folder, (1, 1))
    assert (first, stage()) == (5, 5)
    put(6)
    os.utime(folder, (1, 1))
    assert stage() == 6


def test_stream_with_the_run_distance(spark, tmp_path):
    from codeshift.streaming.transcripts import start_records_stream
    msgs = P.messages(spark, SF).where("session_id < 6")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_chat_json(msgs, src, model="m", run_ts="2024-06-03_17-28", layout="files")
    start_records_stream(spark, src, out, distance="ndiff").awaitTermination()
    got = spark.read.parquet(out).select("session_id", "updated_code", "original_levenshtein_distance")
    want = assemble_records(extract_pairs(msgs), distance="ndiff").select("session_id", "updated_code", "original_levenshtein_distance")
    assert sorted(map(tuple, got.withColumn("session_id", F.col("session_id").cast("long")).collect())) == sorted(map(tuple, want.collect()))


def test_listing_many_folders_takes_as_many_tasks_as_keep_the_cores_busy(spark, tmp_path):
    from codeshift.sources.files import list_files
    most = 4 * spark.sparkContext.defaultParallelism
    for n in range(most + 40):
        (tmp_path / f"session_id={n}").mkdir()
        (tmp_path / f"session_id={n}" / "part-0.txt").write_text("[]")
    spark.sparkContext.setJobGroup("listing", "listing")
    files = list_files(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    stages_ = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages_ and max(tracker.getStageInfo(s).numTasks for s in stages_) <= most
    assert files.count() == most + 40


def test_a_stream_of_files_lists_them_in_as_many_tasks_as_keep_the_cores_busy(spark, tmp_path):
    from codeshift.streaming.transcripts import read_transcript_stream
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(key)
    read_transcript_stream(spark, str(tmp_path))
    assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism


def _sessions(spark, sessions, text="t"):
    return spark.createDataFrame([(s, i, "user", f"{text} {s}.{i}\nß", "") for s in sessions for i in (0, 1, 2)],
                                 "session_id string, idx long, role string, content string, prompt string")


ODD = ["a/b", "x=1", "50%", "ü b", "", "7", "c'd", "q?"]


def test_a_run_of_files_is_written_by_its_tasks_as_spark_writes_it(spark, tmp_path):
    d, run = str(tmp_path / "runs"), tmp_path / "runs/model=m/run_ts=2024-06-03_17-28"
    write_chat_json(_sessions(spark, ["gone", "7"], "old"), d, model="m", run_ts="2024-06-03_17-28", layout="files")
    write_chat_json(_sessions(spark, ODD), d, model="m", run_ts="2024-06-03_17-28", layout="files")
    spark.createDataFrame([(s, "v") for s in ODD], "session_id string, value string").write.partitionBy("session_id").text(str(tmp_path / "spark"))
    folders = lambda p: sorted(f.name for f in p.iterdir() if f.is_dir())
    assert folders(run) == folders(tmp_path / "spark")
    assert (run / "_SUCCESS").exists() and [f.name for f in run.parent.iterdir()] == [run.name]
    for folder in (f for f in run.iterdir() if f.is_dir()):
        file, = folder.iterdir()                        # no checksum beside it: that costs processes
        assert [m["content"][:2] for m in json.loads(file.read_text())] == ["t "] * 3
    want = {(s or None, i, f"t {s}.{i}\nß") for s in ODD for i in (0, 1, 2)}
    assert {(r["session_id"], r["idx"], r["content"]) for r in scan_chat_json(spark, d, layout="files").collect()} == want
    write_chat_json(_sessions(spark, []), d, model="m", run_ts="2024-06-03_17-28", layout="files")
    assert [f.name for f in run.iterdir()] == ["_SUCCESS"]


def test_a_run_that_fails_leaves_the_old_one(spark, tmp_path):
    d = str(tmp_path / "runs")
    write_chat_json(_sessions(spark, ["1", "2"]), d, model="m", run_ts="2024-06-03_17-28", layout="files")
    broken = _sessions(spark, ["1", "3"]).withColumn("content", F.when(F.col("session_id") == "3", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        write_chat_json(broken, d, model="m", run_ts="2024-06-03_17-28", layout="files")
    assert {r["session_id"] for r in scan_chat_json(spark, d, layout="files").collect()} == {1, 2}
    assert [f.name for f in (tmp_path / "runs/model=m").iterdir()] == ["run_ts=2024-06-03_17-28"]


@pytest.mark.parametrize("sessions", [["1", "2", "30"], ["1", "-4294967296"], ["007", "x"], ["a", "b"], ["1.5", "2"], ["2024-01-01"],
                                      ["1", ""], ["nan", "1"], ["a%2Fb", "T12"], ["2024-01-01_10-00"]])
def test_files_are_listed_as_spark_lists_them(spark, tmp_path, sessions):
    for n, s in enumerate(sessions):
        f = tmp_path / f"model=m-{n}" / f"session_id={s or '__HIVE_DEFAULT_PARTITION__'}"
        f.mkdir(parents=True)
        for name, text in (("part-0.txt", "x"), ("empty.txt", ""), (".hidden", "x"), ("_hidden", "x")):
            (f / name).write_text(text)
    (tmp_path / "_hidden").mkdir()
    want = spark.read.format("binaryFile").load(str(tmp_path)).drop("modificationTime", "length", "content")
    got = list_files(spark, str(tmp_path))
    assert got.select(*want.columns).dtypes == want.dtypes and got.columns[0] == "file_name"
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r["file_name"] for r in got.collect()} == {"part-0.txt"}


def test_chosen_files_are_opened_by_tasks(spark, tmp_path):
    """Names of files do not pass through the driver: nothing runs until the result is read."""
    for n in range(40):
        (tmp_path / f"session_id={n}").mkdir()
        (tmp_path / f"session_id={n}" / "part 0%.txt").write_bytes(f"text {n}\n\xff".encode("latin-1"))
    chosen = list_files(spark, str(tmp_path)).where("session_id % 2 = 0")
    spark.sparkContext.setJobGroup("chosen", "chosen")
    got = read_chosen(spark, str(tmp_path), chosen, ("session_id",))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("chosen")
    want = spark.read.text(str(tmp_path), wholetext=True).where("session_id % 2 = 0").select(
        "session_id", F.lit("part 0%.txt").alias("file_name"), F.col("value").alias("text"))
    rows = lambda df: sorted(map(tuple, df.withColumn("text", F.hex("text")).collect()))
    assert got.dtypes == want.dtypes and rows(got) == rows(want) and len(rows(got)) == 20


def test_a_session_is_one_file_where_a_join_deals_it_to_several_tasks(spark, tmp_path):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        m = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")).alias("session_id"), F.col("id").alias("idx"),
                                              F.lit("user").alias("role"), F.sha2(F.col("id").cast("string"), 512).alias("content"), F.lit("").alias("prompt"))
        write_chat_json(m, str(tmp_path), model="m", run_ts="2024-06-03_17-28", layout="files")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    folders = [f for f in (tmp_path / "model=m/run_ts=2024-06-03_17-28").iterdir() if f.is_dir()]
    assert len(folders) == 1201 and all(len(list(f.iterdir())) == 1 for f in folders)
    file, = (tmp_path / "model=m/run_ts=2024-06-03_17-28/session_id=1").iterdir()
    assert [m["content"] for m in json.loads(file.read_text())] == [sha512(str(n).encode()).hexdigest() for n in range(6000) if n % 10 < 8]
