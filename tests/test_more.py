import json
import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.vectors import dimension_errors, mock_embedding
from lodestrata.operators import payloads as P
from lodestrata.sources.ontology import load_ontology, ontology_errors
from lodestrata.sources.synthetic import synthetic_filings


def test_mock_embeddings_are_unit_vectors_of_the_text(spark):
    got = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(mock_embedding(F.col("t"), 40).alias("v")).collect()
    assert all(len(r["v"]) == 40 and math.isclose(sum(x * x for x in r["v"]), 1) for r in got)
    assert got[0] == got[1] != got[2]
    assert spark.createDataFrame([([1.0],), (None,)], "v array<double>").select(dimension_errors(F.col("v"), 2)).collect() == [("BAD_DIMENSIONS",), ("MISSING_VECTOR",)]


def test_ontology(spark):
    m = {"id": "arr", "canonical_name": "ARR", "family_id": "f", "kind": "kpi", "value_type": "money", "unit": "USD", "aliases": ["annual recurring revenue"], "comparability_key_fields": ["unit"]}
    df, h = load_ontology(spark, json.dumps({"metrics": [m], "families": [{"id": "f", "metric_ids": ["arr"]}]}))
    assert df.count() == 1 and h.startswith("sha256:")
    assert ontology_errors({"metrics": [m | {"kind": "x"}], "families": [{"metric_ids": ["nrr"]}]}) == ["BAD_KIND:arr", "NOT_IN_A_FAMILY:arr", "UNKNOWN_IN_FAMILY:nrr"]
    with pytest.raises(ValueError):
        load_ontology(spark, json.dumps({"metrics": [m, m], "families": []}))


def test_synthetic_filings_repeat(spark):
    a, b = (sorted(map(tuple, synthetic_filings(spark, 8, 3).collect())) for _ in range(2))
    assert a == b and len(a) == 24 and len({r[2] for r in a}) == 24


def test_parts_and_counters(spark):
    rows = spark.createDataFrame([("s", "crpo", -90.0), ("s", "rpo", 100.0), ("t", "crpo", 101.0), ("t", "rpo", 100.0), ("u", "crpo", 100.4), ("u", "rpo", 100.0), ("v", "crpo", 1.0), ("v", "crpo", 2.0), ("v", "rpo", 1.0)], "k string, m string, v double")
    assert {tuple(r) for r in P.part_within_whole(rows, ["k"], "m", "v", "crpo", "rpo").collect()} == {("s", True), ("t", False), ("u", True)}
    assert [tuple(r) for r in P.merged_counters(rows, "m", ["v"]).orderBy("m").collect()] == [("crpo", 101.0), ("rpo", 100.0)]
    d = spark.createDataFrame([("a", " ARR "), ("b", "nrr")], "metric_id string, definition string")
    assert [tuple(r) for r in P.alias_hits(d, spark.createDataFrame([("b", "arr"), ("a", "arr")], "metric_id string, alias string")).collect()] == [("a", "b")]
