"""The problem queries on the smallest tables against DuckDB, and on empty ones."""

import os
import shutil

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found"])
def test_same_rows_as_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(f"{d}/{f}")
    yield str(d)
    shutil.rmtree(d)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "hybrid_rrf_queries", "index_knn", "sibling_summary", "fulltext_topk", "claim_fold", "span_segments", "amendment_chains"])
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() == 0


def test_facts_plan_has_no_python_in_the_hot_path(spark):
    for name in ("fused_candidates", "prior_facts_asof", "span_segments", "segments_sum"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["segment_narrowest_span", "section_segment_spans", "hybrid_rrf_queries", "quote_occurrences"])
def test_whole_jobs_give_the_rows_of_their_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, got.collect())
    assert found and found == rows(columns, want.fetchall())


def test_every_covered_segment_has_its_narrowest_span(spark):
    key = ["document_version_id", "at"]
    asked = entry.queries()["span_segments"](spark, DATA).withColumnRenamed("seg_start", "at").select(key)
    found = entry.queries()["segment_narrowest_span"](spark, DATA).select(key)
    assert asked.exceptAll(found).count() == found.exceptAll(asked).count() == 0


def test_histories_use_estimated_units(spark, tmp_path):
    for name in ("documents", "document_versions"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{DATA}/kpi_payloads.parquet").limit(0).write.parquet(f"{tmp_path}/kpi_payloads.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").createOrReplaceTempView("estimated_documents")
    spark.read.parquet(f"{tmp_path}/document_versions.parquet").createOrReplaceTempView("estimated_versions")
    dated = spark.sql("SELECT v.id, min(d.published_at) AS p FROM estimated_versions v JOIN estimated_documents d ON v.document_id = d.id GROUP BY 1 ORDER BY p").collect()
    early, late = dated[0]["id"], dated[-1]["id"]
    schema = spark.read.parquet(f"{DATA}/financial_facts.parquet").schema
    said = [(early, f"a{i}", i, "USD", str(i * 1000)) for i in range(1, 9)] + [(early, f"b{i}", i, "zorkmids", str(i)) for i in range(1, 9)] + [(late, f"c{i}", i, "zorkmids", str(i + 1)) for i in range(1, 9)]
    facts = [tuple({"id": k, "entity_id": "e", "document_version_id": v, "concept": f"x{i}", "unit": u, "value": n, "scale": 0}.get(f.name) for f in schema) for v, k, i, u, n in said]
    spark.createDataFrame(facts, schema).write.parquet(f"{tmp_path}/financial_facts.parquet")
    assert {r["fact_id"] for r in entry.queries()["p3_found"](spark, str(tmp_path)).collect()} == {f"{c}{i}" for c in "ac" for i in range(1, 9)}
