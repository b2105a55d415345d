import pytest
from pyspark.sql import functions as F

from lodestrata.llm.survivors import survivors

SCHEMA = "g string, h string, id string, conf double, label string, n int"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["group_id"]: r for r in survivors(df, ["g", "h"], "id", [F.coalesce("conf", F.lit(-1.0))], ["label", "conf"]).collect()}


def test_fields_come_from_the_best_record_that_has_them(spark):
    rows = [
        ("a", "x", "03", 0.9, None, 1), ("a", "x", "02", 0.9, " ", 1), ("a", "x", "04", 0.5, "low", 1), ("a", "x", "05", None, "none", 1),
        ("b", "x", "11", None, None, 1), ("b", "x", "10", None, None, 1),
        ("c", "x", "20", 1.0, "single", 1), ("c", "x", "20", 1.0, "single", 1), (None, "x", "30", 1.0, "", 1), (None, "x", "31", 1.0, "", 1),
    ]
    got = run(spark, rows + rows[:2])
    assert set(got) == {"02", "10"}
    assert (got["02"]["survivor_id"], got["02"]["label"], got["02"]["label_from"], got["02"]["conf_from"]) == ("02", "low", "04", "02")
    assert (got["10"]["survivor_id"], got["10"]["label"], got["10"]["label_from"], got["10"]["conf"]) == ("10", None, None, None)


def test_empty(spark):
    assert run(spark, []) == {}


def test_duplicates_use_estimated_units(spark, tmp_path):
    import os

    from lodestrata.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("test tables are not here")
    spark.read.parquet(f"{data}/kpi_payloads.parquet").limit(0).write.parquet(f"{tmp_path}/kpi_payloads.parquet")
    schema = spark.read.parquet(f"{data}/financial_facts.parquet").schema
    said = [("v1", f"a{i}", i, "USD", str(i * 1000)) for i in range(1, 9)] + [("v1", f"b{i}", i, "zorkmids", str(i)) for i in range(1, 9)] + [("v2", f"c{i}", i, "zorkmids", str(i + 1)) for i in range(1, 9)]
    facts = [tuple({"id": k, "entity_id": "e", "document_version_id": v, "concept": f"x{i}", "unit": u, "value": n, "scale": 0}.get(f.name) for f in schema) for v, k, i, u, n in said]
    spark.createDataFrame(facts, schema).write.parquet(f"{tmp_path}/financial_facts.parquet")
    assert {r["group_id"] for r in queries.queries()["p7_found"](spark, str(tmp_path)).collect()} == {f"a{i}" for i in range(1, 9)}
