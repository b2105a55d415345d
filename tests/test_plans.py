import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import texts as X
from lodestrata.operators import benchmark as B
from lodestrata.operators import claims as C
from lodestrata.operators import payloads as P
from lodestrata.operators import retrieval as R
from lodestrata.operators import spans as S
from lodestrata.plans.planner import PlanError, index_spec, plan_query


def test_plans_and_their_errors():
    p = plan_query(" How did revenue change? ", "2024-05-01T00:00:00Z", "2024-04-01T02:00:00+02:00", lanes=["tables", "dense"], top_k=20, synonyms={"revenue": "sales", "x": "y"}, forms=[])
    assert p.as_of == "2024-04-01T00:00:00Z" and p.lanes == ("tables", "dense") and p.forms is None and p.budgets.context == 16
    assert p.variants == ("How did revenue change?", "How did sales change?") and p.id() == plan_query(p.question, p.as_of, p.as_of, ["tables", "dense"], 20, {"revenue": "sales"}).id()
    for code, kw in (("EMPTY_QUESTION", {"question": " "}), ("BAD_TOP_K", {"top_k": 0}), ("UNKNOWN_LANE", {"lanes": ["x"]}), ("DUPLICATE_LANE", {"lanes": ["tables", "dense", "dense"]}), ("EMPTY_LANES", {"lanes": []}), ("BAD_PERIOD", {"periods": ["2024-Q5"]}), ("NAIVE_CUTOFF", {"as_of": "2024-01-01T00:00:00"}), ("BAD_CUTOFF", {"as_of": "soon"})):
        with pytest.raises(PlanError) as e:
            plan_query(**({"question": "q", "as_of": "2024-01-01T00:00:00Z", "workspace_as_of": "2024-01-01T00:00:00Z"} | kw))
        assert e.value.code == code
    assert index_spec("c", "p", "m", {"a": 1})["id"] != index_spec("c", "p", "m", {"a": 2})["id"]


def test_fusion_keeps_the_winners_own_appearances(spark):
    rows = [("r", "A", "dense", 1, "p1"), ("r", "A", "lexical", 2, "p1"), ("r", "B", "dense", 2, "p2"), ("r", "C", "facts", 3, "p1"), ("r", "A", "dense", 1, "p1"), ("s", "D", "dense", 1, "p1")]
    fused, decisions = R.fuse(spark.createDataFrame(rows, "run_id string, item_id string, lane string, lane_rank int, provenance string"))
    assert [(r["item_id"], str(r["fused_score"]), r["fused_rank"]) for r in fused.orderBy("run_id", "fused_rank").collect()] == [("A", "0.032522474881", 1), ("B", "0.016129032258", 2), ("D", "0.016393442623", 1)]
    assert {(r["item_id"], r["merged_into"]) for r in decisions.collect() if not r["kept"]} == {("C", "A")}


def test_exact_knn_matches_brute_force_and_zero_vectors(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = np.vstack([r.normal(size=(60, 8)), np.zeros((1, 8)), np.ones((2, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    got = {}
    for x in R.exact_knn(df, asked, "id", "v", 5).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["item_id"]
    d = v.astype(float)
    n = np.linalg.norm(d, axis=1)
    for q in range(0, 63, 10):
        with np.errstate(invalid="ignore"):
            c = np.where(n * n[q] == 0, 1.0, 1 - d @ d[q] / (n * n[q]))
        assert [got[q][k] for k in range(1, 6)] == sorted(range(63), key=lambda i: (round(c[i], 6), i))[:5]


def test_scores_claims_and_payload_functions(spark):
    df = spark.createDataFrame([("the cat sat", "The CAT sat down", "12.50", 3), ("", "x", "0", None), (None, None, None, 1)], "a string, b string, v string, s int")
    got = df.select(C.coverage(F.col("a"), F.col("b")).alias("c"), P.canonical_magnitude(F.col("v"), F.col("s")).alias("m"), X.approx_tokens(F.col("a")).alias("n")).collect()
    assert (got[0]["c"], got[0]["m"], got[0]["n"]) == (1.0, "125e2", 3) and (got[1]["c"], got[1]["m"], got[1]["n"]) == (0.0, "0e0", 0) and got[2]["m"] is None
    t = spark.createDataFrame([("password=abc 'x y'\n z",)], "t string").select(X.redact(F.col("t"))).first()[0]
    assert t == "password=*** '?' z"
    e = spark.createDataFrame([("c", "contradictory"), ("c", "entailed"), ("d", "partial"), ("e", None)], "claim_id string, edge string")
    assert {(r["claim_id"], r["status"]) for r in C.fold_claims(e).collect()} == {("c", "contradicted"), ("d", "partially_supported"), ("e", "unsupported")}


def test_segments_match_brute_force(spark):
    r = random.Random(1)
    spans = [("g", f"s{i}", a, a + r.randint(0, 9)) for i in range(25) for a in [r.randint(0, 40)]]
    got = {(x["seg_start"], x["seg_end"], x["covers"]) for x in S.segments(spark.createDataFrame(spans + spans[:3], "g string, id string, start_char int, end_char int"), "g").collect()}
    edges = sorted({x for s in spans if s[3] > s[2] for x in s[2:]})
    assert got == {(a, b, n) for a, b in zip(edges, edges[1:]) if (n := sum(s[2] <= a and s[3] >= b for s in spans if s[3] > s[2]))}


@pytest.mark.parametrize("few", [256, 2])
def test_narrowest_span_matches_brute_force(spark, few):
    r = random.Random(2)
    spans = [(r.choice("gh"), f"s{i:02d}", a, a + r.randint(0, 30)) for i in range(60) for a in [r.randint(0, 90)]]
    points = [(g, x) for g in "ghi" for x in range(0, 125, 3)]
    df = spark.createDataFrame(spans + spans[:5] + [(None, "n", 0, 9)], "g string, id string, start_char int, end_char int")
    got = {tuple(x) for x in S.narrowest_spans(df, spark.createDataFrame(points + points[:2], "g string, at int"), "g", few).collect()}
    want = set()
    for g, x in points:
        if over := [(e - s, i) for k, i, s, e in spans if k == g and s <= x < e]:
            want.add((g, x, min(over)[1]))
    assert got == want


def test_quotes_and_cutoffs(spark):
    q = spark.createDataFrame([("1", "a", "s", "cat"), ("2", "a", "s", "dog"), ("3", "a", "s", "t")], "quote_id string, accession string, section string, quote string")
    s = spark.createDataFrame([("a", "s", "x", "the cat"), ("a", "s", "y", "a tree"), ("a", "t", "z", "dog")], "accession string, section string, span_id string, text string")
    assert {(r["quote_id"], r["span_id"], r["code"]) for r in B.resolve_quotes(q, s).collect()} == {("1", "x", None), ("2", None, "UNRESOLVED_QUOTE"), ("3", None, "AMBIGUOUS_QUOTE")}
    t = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 12), "evidence"), (datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 12), "evidence"), (datetime(2024, 1, 1), datetime(2024, 1, 1, 12), "future_revision"), (None, datetime(2024, 1, 1), "evidence")], "a timestamp, b timestamp, r string")
    assert [x[0] for x in t.select(B.temporal_codes(F.col("a"), F.col("b"), F.col("r"))).collect()] == ["EVIDENCE_AFTER_CUTOFF", None, "REVISION_NOT_AFTER_CUTOFF", "UNKNOWN_ACCESSION"]
    n = spark.createDataFrame([("3/4", "1.5-2"), ("1/0", "3-2"), ("x", None)], "a string, b string").select(B.parsed_ratio(F.col("a")), B.parsed_range(F.col("b"))["high"].cast("double")).collect()
    assert [tuple(x) for x in n] == [(0.75, 2.0), (None, None), (None, None)]
    m = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, True)], "q string, rank int, rel boolean")
    assert tuple(B.rank_metrics(m, "q", "rank", "rel", 2).first()) == ("q", 0.5, 0.5, pytest.approx(0.386853))


def test_the_entry_loads_without_a_session_and_without_the_text_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['lodestrata.llm'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'p1_found' in q; print('p8_ids' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip() == "False", done.stderr


@pytest.mark.parametrize("few", [256, 2])
def test_section_segments_list_their_spans(spark, few):
    r = random.Random(4)
    sections = [("g", 5, 60), ("h", 0, 20), ("i", 7, 9), ("j", 3, 3)]
    spans = [(f"s{i:02d}", r.choice("ggghk"), a, a + r.randint(0, 12)) for i in range(50) for a in [r.randint(0, 58)]]
    df = spark.createDataFrame(spans + spans[:4], "id string, section_id string, start_char int, end_char int")
    got = [tuple(x) for x in S.section_segments(df, spark.createDataFrame(sections + sections[:1], "id string, start_char int, end_char int"), few).collect()]
    want = set()
    for g, s, e in sections:
        mine = {x for x in spans if x[1] == g and s <= x[2] < x[3] <= e}
        edges = sorted({s, e} | {y for x in mine for y in x[2:]})
        for a, b in zip(edges, edges[1:]):
            want |= {(g, a, b, x[0]) for x in mine if x[2] <= a and x[3] >= b} or {(g, a, b, None)}
    assert len(got) == len(want) and set(got) == want and any(x[3] is None for x in want)


def test_whole_quotes_in_the_texts_of_accessions(spark):
    q = spark.createDataFrame([("1", "the cat sat down"), ("2", "a dog"), ("3", "never said at all"), ("4", "")], "quote_id string, quote string")
    s = spark.createDataFrame([("a", 1, "So the cat sat downstairs."), ("a", 2, "the cat sat up"), ("b", 3, "the cat sat down, a dog"), ("b", 4, "the cat sat down"), (None, 5, "a dog")], "accession string, span_id long, text string")
    want = {("1", "a", 1, 1, None), ("1", "b", 2, None, "AMBIGUOUS_QUOTE"), ("2", "b", 1, 3, None), ("2", None, 1, 5, None), ("3", None, 0, None, "UNRESOLVED_QUOTE"), ("4", None, 0, None, "UNRESOLVED_QUOTE")}
    got = [tuple(x) for x in B.quote_scopes(q, s).collect()]
    assert len(got) == len(want) and set(got) == want


def test_texts_that_files_make_small_are_not_broadcast(spark, tmp_path):
    quote = "the pilot plant was stopped"
    texts = spark.range(1500).select(F.concat(F.lit("a"), F.col("id") % 9).alias("accession"), F.col("id").alias("span_id"), F.concat(F.repeat(F.lit("filler "), F.lit(9000)), F.when(F.col("id") % 500 == 7, quote).otherwise("none")).alias("text"))
    texts.write.parquet(f"{tmp_path}/texts")
    q = spark.createDataFrame([("1", quote), ("2", "was not there at all")], "quote_id string, quote string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", 80 << 20)
    try:
        got = B.quote_scopes(q, spark.read.parquet(f"{tmp_path}/texts")).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(map(tuple, got), key=str) == [("1", "a3", 1, 507, None), ("1", "a7", 1, 7, None), ("1", "a8", 1, 1007, None), ("2", None, 0, None, "UNRESOLVED_QUOTE")]


def test_each_text_of_a_quote_is_looked_for_in_blocks_or_by_parts(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 4)
    q = spark.createDataFrame([("1", "we sold more"), ("1", "it had fewer"), ("2", "id it"), ("2", "old"), ("3", "absent"), (None, "sold")], "quote_id string, quote string")
    texts = [("x", "s1", "we sold more of it"), ("x", "s2", "it had fewer"), ("x", "s3", "so it had fewer"), ("y", "s4", "we did it"), ("z", "s5", "all old")]
    s = spark.createDataFrame([*texts, (None, "s6", None)], "accession string, span_id string, text string")
    got = {tuple(r) for r in B.quote_scopes(q, s).collect()}
    assert got == {("1", "x", 3, None, "AMBIGUOUS_QUOTE"), ("2", "x", 1, "s1", None), ("2", "y", 1, "s4", None), ("2", "z", 1, "s5", None), ("3", None, 0, None, "UNRESOLVED_QUOTE"), (None, None, 0, None, "UNRESOLVED_QUOTE")}
