"""Retrieval queries: lanes, fusion, recall, claims, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import claims as C
from lodestrata.operators import quality as Q
from lodestrata.operators import retrieval as R
from lodestrata.plans.registry import Registry
from lodestrata.plans.tables import table

query = Registry()
TERMS = ["revenue", "operations"]
DISTANCE_SQL = """CASE WHEN sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x))) = 0 THEN 1.0
  ELSE 1 - list_dot_product(a, b) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) END"""
PAIRS_SQL = f"""pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, round({DISTANCE_SQL.replace('(a,', '(v.a,').replace('(b,', '(q.a,').replace('(a, b)', '(v.a, q.a)').replace('product(v.a, b)', 'product(v.a, q.a)')}, 6) + 0.0 AS distance
  FROM e v CROSS JOIN (SELECT * FROM e WHERE vec_id % 50 = 0) q)"""
E_SQL = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, label FROM embeddings)"


def neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k nearest of all vectors for every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.exact_knn(e, asked, "vec_id", "embedding", k)


@query(f"WITH {E_SQL}, {PAIRS_SQL} SELECT query_id, item_id, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 10")
def exact_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 10)


@query(f"""WITH {E_SQL}, {PAIRS_SQL}, top AS (SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS n FROM pairs) WHERE n <= 10)
  SELECT query_id, round(count(*) FILTER (i.label = q.label) / 10.0, 6) AS precision_at_10 FROM top t JOIN embeddings i ON t.item_id = i.vec_id JOIN embeddings q ON t.query_id = q.vec_id GROUP BY 1""")
def knn_label_precision(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = neighbours(spark, d, 10).join(labels.withColumnsRenamed({"vec_id": "item_id", "label": "__i"}), "item_id").join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "__q"}), "query_id")
    return near.groupBy("query_id").agg(F.round(F.count_if(F.col("__i") == F.col("__q")) / 10.0, 6).alias("precision_at_10"))


LEXICAL_SQL = f"""lex AS (SELECT doc_id AS item_id, round(len(list_filter(w, lambda x: x IN ('revenue', 'operations'))) / sqrt(len(w)), 6) AS score
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE list_contains(w, 'revenue') AND list_contains(w, 'operations'))"""


@query(f"WITH {LEXICAL_SQL} SELECT item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM lex) WHERE rank <= 100")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    top = R.lexical_scores(table(spark, d, "documents"), "doc_id", "text", TERMS).orderBy(F.col("score").desc(), "item_id").limit(100)
    return R.ranked(top, [], [F.col("score").desc(), F.col("item_id")])


@query(f"""WITH {E_SQL}, {LEXICAL_SQL}, {PAIRS_SQL}, lex_lane AS (SELECT item_id, r FROM (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS r FROM lex) WHERE r <= 100),
  lanes AS (SELECT q.vec_id AS query_id, item_id, r FROM lex_lane CROSS JOIN (SELECT vec_id FROM e WHERE vec_id % 50 = 0) q UNION ALL SELECT query_id, item_id, r FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS r FROM pairs) WHERE r <= 100),
  fused AS (SELECT query_id, item_id, CAST(sum(CAST(round(1::DOUBLE / (60 + r), 12) AS DECIMAL(13,12))) AS DECIMAL(16,12)) AS fused_score FROM lanes GROUP BY ALL)
  SELECT query_id, item_id, CAST(fused_score AS DOUBLE) AS fused_score, fused_rank, CASE WHEN fused_rank <= 16 THEN 'accepted' ELSE 'beyond_context_budget' END AS decision
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, item_id) AS INTEGER) AS fused_rank FROM fused) WHERE fused_rank <= 100""")
def hybrid_rrf_queries(spark: SparkSession, d: str) -> DataFrame:
    """Dense and lexical lanes over the same ids, fused for every vector whose id is divisible by 50: each has its own dense lane, fusion and context; the terms are the same for all."""
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    dense = neighbours(spark, d, 100).select("query_id", "item_id", F.lit("dense").alias("lane"), F.col("rank").alias("lane_rank"))
    lexical = lexical_topk(spark, d).crossJoin(asked).select("query_id", "item_id", F.lit("lexical").alias("lane"), F.col("rank").alias("lane_rank"))
    both = dense.unionByName(lexical).withColumn("provenance", F.col("item_id").cast("string"))
    # fuse and context work per run; the window and the budget of each run are its own
    fused, _ = R.fuse(both.withColumnRenamed("query_id", "run_id"))
    return R.context(R.rerank(fused), 16).withColumnRenamed("run_id", "query_id").withColumn("fused_score", F.col("fused_score").cast("double"))


CANDIDATES_SQL = """c AS (SELECT DISTINCT run_id, item_id, lane, lane_rank, kind, source_span_id, document_version_id, financial_fact_id, table_row_index FROM lane_candidates),
k AS (SELECT run_id, item_id, lane, min(lane_rank) AS r, min(CASE WHEN financial_fact_id IS NOT NULL THEN 'fact|' || financial_fact_id WHEN table_row_index IS NOT NULL THEN 'row|' || coalesce(document_version_id, '-') || '|' || coalesce(source_span_id, '-') || '|' || table_row_index
  ELSE 'span|' || kind || '|' || coalesce(source_span_id, '-') END) AS p FROM c GROUP BY ALL),
i AS (SELECT run_id, item_id, min(r) AS best, min(p) AS p, CAST(sum(CAST(round(1::DOUBLE / (60 + r), 12) AS DECIMAL(13,12))) AS DECIMAL(16,12)) AS fused_score FROM k GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY run_id, p ORDER BY best, item_id) AS n, first(item_id) OVER (PARTITION BY run_id, p ORDER BY best, item_id) AS winner FROM i)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").select("run_id", "item_id", "lane", "lane_rank", "kind", "source_span_id", "document_version_id", "financial_fact_id", "table_row_index").distinct()
    return c.withColumn("provenance", R.provenance_key(F.col("kind"), F.col("financial_fact_id"), F.col("document_version_id"), F.col("table_row_index"), F.col("source_span_id")))


@query(f"WITH {CANDIDATES_SQL} SELECT run_id, item_id, CAST(fused_score AS DOUBLE) AS fused_score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY fused_score DESC, item_id) AS INTEGER) AS fused_rank FROM w WHERE n = 1")
def fused_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(candidates(spark, d))[0].withColumn("fused_score", F.col("fused_score").cast("double"))


@query(f"WITH {CANDIDATES_SQL} SELECT run_id, item_id, n = 1 AS kept, CASE WHEN n > 1 THEN winner END AS merged_into FROM w")
def fusion_decisions(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(candidates(spark, d))[1]


@query("""SELECT DISTINCT id, lane, item_id FROM lane_candidates WHERE published_at <= TIMESTAMPTZ '2022-06-30 12:00:00+00' AND kind IN ('fact', 'table_row')""")
def lane_visible(spark: SparkSession, d: str) -> DataFrame:
    return R.lane_filter(table(spark, d, "lane_candidates"), F.lit("2022-06-30 12:00:00").cast("timestamp"), kinds=["fact", "table_row"]).select("id", "lane", "item_id").distinct()


@query("""WITH g AS (SELECT run_id, list(DISTINCT item_id) FILTER (lane = 'facts') AS gold FROM lane_candidates GROUP BY 1),
  f AS (SELECT run_id, list(item_id ORDER BY lane_rank, item_id)[1:10] AS found FROM (SELECT DISTINCT run_id, item_id, lane_rank FROM lane_candidates WHERE lane = 'dense') GROUP BY 1)
  SELECT g.run_id, round(CASE WHEN coalesce(len(gold), 0) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(found, []), gold)) / len(gold) END, 6) AS recall_at_10 FROM g LEFT JOIN f ON g.run_id = f.run_id""")
def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates")
    gold = c.groupBy("run_id").agg(F.collect_set(F.when(F.col("lane") == "facts", F.col("item_id"))).alias("gold"))
    found = c.where("lane = 'dense'").select("run_id", "item_id", "lane_rank").distinct().groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane_rank", "item_id"))), lambda x: x["item_id"]).alias("found"))
    joined = gold.join(found, "run_id", "left")
    return joined.select("run_id", F.round(R.recall(F.coalesce("found", F.array().cast("array<string>")), F.col("gold"), 10), 6).alias("recall_at_10"))


@query("""SELECT lane, count(*) AS n_candidates, count(DISTINCT run_id) AS n_runs, count(DISTINCT item_id) AS n_items, min(lane_rank) AS best, max(lane_rank) AS worst FROM (SELECT DISTINCT id, lane, run_id, item_id, lane_rank FROM lane_candidates) GROUP BY 1""")
def lane_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").select("id", "lane", "run_id", "item_id", "lane_rank").distinct()
    return c.groupBy("lane").agg(F.count("*").alias("n_candidates"), F.countDistinct("run_id").alias("n_runs"), F.countDistinct("item_id").alias("n_items"), F.min("lane_rank").alias("best"), F.max("lane_rank").alias("worst"))


@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS c FROM eval_items), q AS (SELECT id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS s, category FROM (SELECT DISTINCT id, category, question FROM manifest_entries)),
  e AS (SELECT q.id, item_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_intersect(s, c)) / len(s) END AS share FROM q JOIN (SELECT e.category, w.* FROM eval_items e JOIN w ON e.item_id = w.item_id) x ON x.category = q.category)
  SELECT id AS claim_id, CASE WHEN bool_or(share >= 1) THEN 'supported' WHEN bool_or(share >= 0.5 AND share < 1) THEN 'partially_supported' ELSE 'unsupported' END AS status FROM e GROUP BY 1""")
def claim_fold(spark: SparkSession, d: str) -> DataFrame:
    """Questions as claims against all evaluation items of their category, folded by their best edge."""
    claims = table(spark, d, "manifest_entries").select(F.col("id").alias("claim_id"), "category", "question").distinct()
    claims = claims.select("claim_id", "category", F.array_sort(C.token_set(F.col("question"))).alias("words"))
    items = table(spark, d, "eval_items").select("category", C.token_set(F.col("text")).alias("words"))
    backed = C.word_support(claims, items, "category")
    able = claims.join(items.select("category").distinct(), "category", "left_semi").select("claim_id").distinct()
    edges = able.join(backed, "claim_id", "left").select("claim_id", C.edge_kind(F.coalesce("share", F.lit(0.0))).alias("edge"))
    return C.fold_claims(edges)


@query("""WITH f AS (SELECT DISTINCT id, document_version_id, entity_id, concept, value, unit, scale, CAST(coalesce(period_instant, period_end) AS VARCHAR) AS period FROM financial_facts WHERE duplicate_of IS NOT NULL),
  o AS (SELECT id, any_value(value) AS value, any_value(unit) AS unit, any_value(scale) AS scale, any_value(CAST(coalesce(period_instant, period_end) AS VARCHAR)) AS period, any_value(duplicate_of) AS duplicate_of FROM financial_facts GROUP BY 1)
  SELECT a.id, array_to_string(list_filter([CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END, CASE WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit' END, CASE WHEN a.period IS DISTINCT FROM b.period THEN 'period' END,
    CASE WHEN (a.value LIKE '-%') IS DISTINCT FROM (b.value LIKE '-%') THEN 'sign' END, CASE WHEN a.scale IS DISTINCT FROM b.scale THEN 'scale' END], lambda x: x IS NOT NULL), ',') AS failed FROM o a JOIN o b ON a.duplicate_of = b.id""")
def numeric_checks(spark: SparkSession, d: str) -> DataFrame:
    """The numeric parts in which a fact differs from the one it names as its original."""
    f = table(spark, d, "financial_facts").select("id", "duplicate_of", "value", "unit", "scale", F.coalesce("period_instant", "period_end").cast("string").alias("period"), F.col("value").startswith("-").alias("sign")).distinct()
    parts = F.struct(*C.NUMERIC_PARTS)
    claim, original = f.where("duplicate_of is not null").select("id", "duplicate_of", parts.alias("a")), f.select(F.col("id").alias("duplicate_of"), parts.alias("b"))
    return claim.join(original, "duplicate_of").select("id", F.array_join(C.failed_parts(F.col("a"), F.col("b")), ",").alias("failed"))


@query("""WITH a AS (SELECT run_id, item_id, min(source_span_id) AS span FROM lane_candidates WHERE lane = 'dense' GROUP BY ALL), c AS (SELECT DISTINCT run_id, item_id, source_span_id FROM lane_candidates WHERE lane <> 'dense')
  SELECT c.*, CASE WHEN a.run_id IS NULL THEN 'DANGLING_CITATION' WHEN a.span IS DISTINCT FROM c.source_span_id THEN 'CROSS_VERSION_CITATION' END AS code FROM c LEFT JOIN a ON a.run_id = c.run_id AND a.item_id = c.item_id""")
def citation_guard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").select("run_id", "item_id", "lane", "source_span_id")
    return C.citation_codes(c.where("lane <> 'dense'").drop("lane").distinct(), c.where("lane = 'dense'"))


@query("""WITH s AS (SELECT category, count(*) AS n, count(*) FILTER (answerable) AS k FROM (SELECT DISTINCT id, category, answerable FROM manifest_entries) GROUP BY 1)
  SELECT category AS metric, round(CASE WHEN n = 0 THEN 1.0 ELSE k / n END, 6) AS value, n AS support, 0.9 AS threshold, (CASE WHEN n = 0 THEN 1.0 ELSE k / n END) >= 0.9 AND n > 0 AS passed FROM s""")
def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest_entries").select("id", "category", "answerable").distinct()
    metrics = m.groupBy(F.col("category").alias("metric")).agg(Q.ratio_or_one(F.count_if("answerable"), F.count("*")).alias("value"), F.count("*").alias("support"))
    gated = Q.gate(metrics, metrics.select("metric", F.lit(0.9).alias("threshold")))
    return gated.withColumn("value", F.round("value", 6))


@query("""SELECT run_id, coalesce(bool_and(lane = 'lexical'), true) AS abstained FROM lane_candidates GROUP BY 1""")
def abstention(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").select("run_id", F.when(F.col("lane") == "lexical", "unsupported").otherwise("supported").alias("status"))
    return C.abstains(c, "run_id")


@query("""SELECT run_id, CAST(seq AS BIGINT) AS seq, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, id) AS seq FROM (SELECT DISTINCT run_id, id, created_at FROM lane_candidates))""")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").select("run_id", "id", "created_at").distinct()
    return c.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "id")).cast("bigint").alias("seq"), "id")
