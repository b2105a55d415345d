import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import claims as C
from lodestrata.operators import fulltext as T
from lodestrata.operators import hot, payloads, quality, vectors
from lodestrata.operators.temporal import sibling_summary


def vector_rows(seed=0, n=400, width=8):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, width)) + 3 * r.normal(size=(12, width))[r.integers(12, size=n)]
    return v, [(i, x.tolist()) for i, x in enumerate(v)]


def test_index_finds_what_the_exact_search_finds(spark):
    v, rows = vector_rows()
    rows += [(900 + i, [1.0] * 8) for i in range(130)]  # a third are copies
    rows += [(2000, None), (2001, [1.0, 2.0]), (2002, [float("nan")] * 8), (2003, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = df.where("id % 50 = 0 and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    exact = {tuple(x) for x in vectors.exact_knn(df, asked, "id", "v", 10).select("query_id", "item_id", "distance").collect()}
    centres, probes = vectors.fit_index(df, "id", "v", 12, 10, rows=200)
    assert 1 <= probes < 12
    index = vectors.indexed(df, "id", "v", centres)
    assert index.count() == df.count() and {r[0] for r in index.where("cell < 0").select("id").collect()} == {2000, 2001, 2002}
    whole = {tuple(x) for x in vectors.index_knn(index, asked, "id", "v", 10, centres, 12).select("query_id", "item_id", "distance").collect()}
    some = {tuple(x) for x in vectors.index_knn(index, asked, "id", "v", 10, centres, probes).select("query_id", "item_id", "distance").collect()}
    assert whole == exact and len(some & exact) >= 0.9 * len(exact)


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    _, rows = vector_rows(1, 60)
    df = spark.createDataFrame([(str(i), x) for i, x in rows], "id string, v array<double>")
    asked = df.select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    one = sorted(map(tuple, vectors.exact_knn(df, asked, "id", "v", 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK_VALUES", 100)
    assert sorted(map(tuple, vectors.exact_knn(df, asked, "id", "v", 3).collect())) == one and len(one) == 180
    none = df.limit(0)
    assert vectors.exact_knn(none, asked, "id", "v", 3).count() == 0 == vectors.exact_knn(df, asked.limit(0), "id", "v", 3).count()
    assert vectors.index_knn(vectors.indexed(none, "id", "v", vectors.fit_cells(none, "id", "v", 4)), asked, "id", "v", 3, vectors.fit_cells(none, "id", "v", 4), 2).count() == 0


def test_words_phrases_alternatives_and_exclusions(spark):
    texts = ["The Companies amended a credit agreement.", "Credit, but no agreement here", "credit agreements and companies in China", "companies' boxes", "", None, "glass ties us"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = lambda q: sorted(r["item_id"] for r in T.search(df, "id", "t", q).collect())
    assert found('"credit agreement"') == [0, 2] and found("credit agreement") == [0, 1, 2] and found("company -china") == [0, 3] and found("boxes OR china") == [2, 3]
    assert found("the of") == [] and found("") == [] and found('company "credit agreement" -amended') == [2] and found("-credit") == [] and found("OR glass") == [6]
    assert [T.stem(w) for w in ("companies", "expenses", "employees", "glass", "status", "ties")] == ["company", "expense", "employee", "glass", "status", "tie"] or T.stem("ties") == "ty"


def test_exact_quantile_matches_sorting(spark):
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(3000)] + [("b", float(r.randint(0, 3))) for _ in range(500)] + [("c", None), ("d", 5.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.95, 0.5, 1.0):
        got = {x["k"]: x["q"] for x in quality.exact_quantile(df, ["k"], "v", share, "q", 50).collect()}
        want = {}
        for k in {"a", "b", "d", None}:
            v = sorted(x for key, x in rows if key == k and x is not None)
            want[k] = next(x for i, x in enumerate(v) if i + 1 >= share * len(v))
        assert got == want
    assert quality.exact_quantile(df.limit(0), ["k"], "v", 0.5, "q").count() == 0


@pytest.mark.parametrize("task_rows", [100_000, 4])
def test_siblings_are_counted_without_pairs(spark, task_rows):
    r = random.Random(3)
    day = datetime(2024, 1, 1)
    rows = [(f"d{i:02d}", r.choice(["x", "x", "y", None]), day + timedelta(days=r.randint(0, 9)) if r.random() < 0.9 else None) for i in range(60)]
    got = {tuple(x) for x in sibling_summary(spark.createDataFrame(rows + rows[:5], "id string, entity_id string, published_at timestamp"), task_rows).collect()}
    want = set()
    for i, e, at in rows:
        if e and at:
            others = [(t, j) for j, f, t in rows if f == e and j != i and t and t <= at]
            want.add((i, len(others), max(others)[1] if others else None, max(others)[0] if others else None))
    assert got == want


def test_word_support_matches_all_pairs(spark):
    r = random.Random(5)
    words = "abcdefghijklmnop"
    claims = [(f"c{i}", r.choice("xy"), sorted(set(r.choices(words, k=r.randint(0, 6))))) for i in range(60)]
    items = [(r.choice("xyz"), sorted(set(r.choices(words, k=r.randint(0, 9))))) for _ in range(25)]
    df, it = spark.createDataFrame(claims, "claim_id string, g string, words array<string>"), spark.createDataFrame(items + items[:3], "g string, words array<string>")
    for least in (0.5, 0.2, 1.0):
        got = {(x["claim_id"], round(x["share"], 9)) for x in C.word_support(df, it, "g", least).collect()}
        best = {(c, round(max((len(set(w) & set(v)) / len(w) for h, v in items if h == g and w), default=0), 9)) for c, g, w in claims}
        assert got == {x for x in best if x[1] >= least and x[1] > 0}


def test_spread_join_matches_a_join(spark):
    r = random.Random(6)
    left = spark.createDataFrame([(r.choice(["hot", "hot", "hot", "a", "b", None]), i) for i in range(200)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("z", 4), (None, 5)], "k string, j int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, hot.spread_join(left, right, ["k"], how, 20).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_json_schemas(spark):
    schema = {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"enum": ["x", "y"]}, "c": {"minLength": 2}, "d": {"type": "array"}}}
    rows = ['{"a": 5, "b": "x", "c": "cc", "d": [1]}', '{"a": 1, "b": "q", "c": "c", "d": 3}', '{"b": null}', "[1]", "no json", None, '{"a": 1.5}']
    got = [x[0] for x in spark.createDataFrame([(x,) for x in rows], "j string").select(payloads.schema_errors(F.col("j"), schema)).collect()]
    assert got == [[], ["a:MINIMUM", "b:ENUM", "c:MIN_LENGTH", "d:TYPE"], ["a:REQUIRED"], [":TYPE"], [":TYPE"], [":TYPE"], ["a:TYPE", "a:MINIMUM"]]
