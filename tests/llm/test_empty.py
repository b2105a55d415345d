import os

import pytest

from lodestrata.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.mark.parametrize("name", ["p4_found", "p4_pieces", "p7_found", "p7_records", "p8_ids", "p9_found", "p10_found"])
def test_empty_tables(spark, tmp_path, name):
    for f in ("documents", "financial_facts", "kpi_payloads", "eval_items", "passage_candidates"):
        spark.read.parquet(f"{DATA}/{f}.parquet").limit(0).write.parquet(f"{tmp_path}/{f}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["p4_found", "p7_found", "p7_records"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_the_entry_lists_the_text_queries():
    import __spark_entry__ as entry

    assert {"p4_found", "p7_found", "p8_ids", "p9_found", "p10_found"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
