"""End-to-end: golden totals, the entry point, and every registered query
against its DuckDB statement on the smallest table folder."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeshift.plans import records as P

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

needs_data = pytest.mark.skipif(not os.path.isdir(SF001), reason="test tables not present")


@needs_data
def test_golden_totals_sf001(spark):
    p = P.pairs(spark, SF01)
    assert p.count() == 202
    assert p.filter(F.col("updated_code") == "").count() == 17
    r = P.records(spark, SF01)
    t = r.agg(*[F.sum(c).alias(c) for c in (
        "updated_LOC", "updated_comment", "updated_blank", "updated_chars", "updated_tokens",
        "original_LOC", "original_comment", "original_blank", "original_chars", "original_tokens")]).collect()[0]
    assert tuple(t) == (2480, 2294, 1614, 108879, 19908, 1344, 1556, 1068, 36897, 7730)


@needs_data
def test_fixture_has_its_cases(spark):
    """Two user blocks, long sessions and varying metrics occur in the tables."""
    from codeshift.operators.normalize import minmax_normalize
    qs = entry.queries()
    assert {r["mode"] for r in qs["build_requests"](spark, SF01).select("mode").distinct().collect()} == {"cumulative", "independent"}
    z = qs["zip_pairs"](spark, SF01).select("session_id", "idx", F.col("original_block").alias("zipped"))
    assert P.pairs(spark, SF01).join(z, ["session_id", "idx"]).where("zipped <> original_block").count() > 10
    scored = P.scored(spark, SF01)
    assert scored.where("original_cyclomatic_complexity > 0").count() > scored.count() / 2
    n = minmax_normalize(scored).select("session_id", "idx", F.col("original_chars").alias("n"))
    assert scored.join(n, ["session_id", "idx"]).where("n <> original_chars").count() > 0


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert set(df.columns) >= {"prompt_id", "pass_rate", "num_elements"}
    assert sum(r["num_elements"] for r in rows) == P.pairs(spark, SF001).count()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@needs_data
def test_all_queries_against_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    failures = []
    for name, fn in qs.items():
        df = fn(spark, SF001)
        srows = [tuple(r) for r in df.collect()]
        if name not in sqls:
            continue
        res = con.execute(sqls[name])
        dcols = [d[0] for d in res.description]
        drows = res.fetchall()
        if sorted(df.columns) != sorted(dcols) or _rows(df.columns, srows) != _rows(dcols, drows):
            failures.append(name)
    assert not failures, failures


@needs_data
def test_sql_views(spark):
    names = P.register_views(spark, SF001)
    assert set(names) == {"session_messages", "pairs", "records", "scored"}
    n = spark.sql("SELECT count(*) AS n FROM records WHERE original_LOC >= 0").first()["n"]
    assert n == P.pairs(spark, SF001).count()
    by = spark.sql("SELECT prompt_id, count(*) AS n FROM scored GROUP BY prompt_id").collect()
    assert sum(r["n"] for r in by) == n


@needs_data
def test_describe_approx_close_to_exact(spark):
    from codeshift.operators import reports as rp
    from codeshift.sources.tables import load_table
    ev = load_table(spark, SF01, "events")
    exact = {r["statistic"]: r["value"] for r in rp.describe(ev, ["value"]).collect()}
    approx = {r["statistic"]: r["value"] for r in rp.describe(ev, ["value"], quantiles="approx").collect()}
    assert set(exact) == set(approx) == {"count", "mean", "std", "min", "25%", "50%", "75%", "max"}
    for k in exact:
        assert abs(exact[k] - approx[k]) <= 0.2, (k, exact[k], approx[k])
