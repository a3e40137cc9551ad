"""The pipeline against brute force: each stage on what its predecessor kept."""

import corpus_pipeline
import numpy as np

from codeshift.llm import toxicity
from codeshift.llm.common import documents, table

from .conftest import SF
from .test_exact_dedup import brute as exact
from .test_packing import check as check_packing, ids_of
from .test_simhash import brute as near
from .test_suffix_dedup import brute_first


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "suffix-array dedup", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = rows(docs), docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns and docs.schema == documents(spark, SF).schema
        kept[name] = before, rows(docs)

    before, after = kept["toxicity"]
    scored = toxicity.toxicity(documents(spark, SF), table(spark, SF, "labels")).collect()
    assert after == sorted((i, t) for i, t in before if i in {r.doc_id for r in scored if not r.predicted})

    before, after = kept["exact dedup"]
    assert after == sorted((i, t) for i, t in before if i in {r[0] for r in exact(before) if r[3]})

    before, after = kept["near dedup"]
    assert after == sorted((i, t) for i, t in before if i in {r[0] for r in near(before) if r[0] == r[2]})

    before, after = kept["suffix-array dedup"]
    assert [i for i, _ in after] == [i for i, _ in before]
    left = dict(brute_first(before, corpus_pipeline.PASSAGE))
    assert dict(after) == {i: k.decode("utf-8", "ignore") for i, k in left.items()}
    assert {r.doc_id: r.n_chars for r in docs.collect()} == {i: len(t) for i, t in after}

    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    bins, tokens = check_packing(after, got)
    assert bins <= -(-tokens // 2048) + 1


def test_run_and_registration(spark, monkeypatch):
    import __spark_entry__
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[1], stages[-1]])
    packed = corpus_pipeline.run(spark, SF)
    kept = {r[0] for r in exact(rows(documents(spark, SF))) if r[3]}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_repeated_rows_reach_packing_once(spark, frame):
    text = {k: " ".join(f"{k}{i * i}" for i in range(300)) for k in "abc"}
    docs = frame([(1, text["a"])] * 3 + [(None, text["b"])] * 2 + [(2, text["c"]), (3, text["c"])])
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, text["b"]), (1, text["a"]), (2, text["c"])]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing([(None, text["b"]), (1, text["a"]), (2, text["c"])], got)


def test_packing_stage_carries_token_ids(spark, frame):
    text = "some words to train on " * 900
    got = corpus_pipeline.STAGES[-1][1](spark, frame([(1, text), (2, None)]), SF).collect()
    for i, t in ((1, text), (2, None)):
        parts = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
        assert np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist() == ids_of(t)


def test_clashing_columns(spark):
    """Columns named like those inside the operators harm no stage."""
    docs = documents(spark, SF)
    names = ["_id", "_stamp", "_score", "_toxic", "_spans", "_kept", "_row", "_text", "_none", "__id", "id", "key", "stamp", "spans", "group"]
    more = docs.select("*", *[docs.lang.alias(n) for n in names])
    plain, wide = docs, more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = corpus_pipeline.materialize(stage(spark, plain, SF), "test")
        wide = corpus_pipeline.materialize(stage(spark, wide, SF), "test")
        assert wide.columns == more.columns and rows(wide) == rows(plain), name
    got = [sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, d, SF).select("doc_id", "piece", "ids_crc32").collect())) for d in (plain, wide)]
    assert got[0] == got[1]
    scores = [sorted(map(tuple, toxicity.toxicity(d, table(spark, SF, "labels")).collect())) for d in (docs, more)]
    assert scores[0] == scores[1]
