"""Queries over ingestion, index building, benchmarks, forecasts and document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import accession_key, uuid_key
from lodestrata.operators import benchmark as B
from lodestrata.operators import ingest as I
from lodestrata.operators import retrieval as R
from lodestrata.operators import temporal as T
from lodestrata.operators.history import snapshots_history
from lodestrata.plans.problems_sql import key
from lodestrata.plans.registry import Registry
from lodestrata.plans.tables import table
from lodestrata.sources.html import parse_documents, table_rows

query = Registry()
FACTS_SQL = "f AS (SELECT DISTINCT id, entity_id, document_version_id, concept, value, unit, scale, period_type, period_instant, period_start, period_end, source_span_id, duplicate_of, restates, ingested_at, fact_key FROM financial_facts)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "financial_facts").dropDuplicates(["id"])


@query("""SELECT DISTINCT id, concept || '|' || coalesce(unit, '') || '|' || CASE WHEN period_type = 'instant' THEN 'instant:' || period_instant ELSE 'duration:' || period_start || ':' || period_end END || '|' ||
  array_to_string(list_transform(list_sort(map_entries(dimensions)), lambda e: e.key || '=' || e.value), ',') AS built FROM financial_facts""")
def fact_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return facts(spark, d).select("id", I.fact_key(c("concept"), c("unit"), c("period_type"), c("period_instant"), c("period_start"), c("period_end"), c("dimensions")).alias("built"))


@query("SELECT doc_id, sha256(accession || '|' || form || '|' || source) AS job_key FROM documents WHERE form IS NOT NULL")
def job_keys(spark: SparkSession, d: str) -> DataFrame:
    k, _ = I.job_key(F.col("accession"), F.col("form"), F.col("source"))
    return table(spark, d, "documents").where("form is not null").select("doc_id", k.alias("job_key"))


@query(f"WITH {FACTS_SQL} SELECT id, first_value(id) OVER w AS canonical_id, first_value(id) OVER w = id AS is_first, first_value(value) OVER w IS DISTINCT FROM value AS conflict FROM f WHERE fact_key IS NOT NULL WINDOW w AS (PARTITION BY document_version_id, fact_key ORDER BY ingested_at, id)")
def first_seen_facts(spark: SparkSession, d: str) -> DataFrame:
    seen = I.first_seen(facts(spark, d).where("fact_key is not null"), "document_version_id", "fact_key", "ingested_at", "value", "id")
    return seen.select("id", "canonical_id", "is_first", "conflict")


@query(f"WITH {FACTS_SQL}, b AS (SELECT document_version_id FROM f WHERE unit LIKE 'iso4217:%') SELECT document_version_id, count(*) AS n FROM f WHERE document_version_id IS NOT NULL AND document_version_id NOT IN (SELECT document_version_id FROM b WHERE document_version_id IS NOT NULL) GROUP BY 1")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    coded = facts(spark, d).where("document_version_id is not null").withColumn("code", F.when(F.col("unit").startswith("iso4217:"), "UNKNOWN_UNIT"))
    return I.split_quarantine(coded, "document_version_id", "code")[0].groupBy("document_version_id").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT DISTINCT source_span_id, start_char, end_char, content, text_hash FROM passage_candidates), q AS (SELECT {key('source_span_id')} AS id, CASE WHEN content IS NULL OR end_char <= start_char OR end_char - start_char > length(content) THEN 'OFFSET_MISMATCH'
  WHEN 'sha256:' || sha256(substr(content, 1, end_char - start_char)) IS DISTINCT FROM text_hash THEN 'HASH_MISMATCH' END AS code FROM p), f AS (SELECT DISTINCT id, {key('source_span_id')} AS s FROM financial_facts WHERE {key('source_span_id')} IS NOT NULL)
  SELECT 'passage' AS kind, coalesce(code, 'accepted') AS outcome, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT 'fact', CASE WHEN q.id IS NULL THEN 'UNANCHORED_FACT' ELSE coalesce(code, 'accepted') END, count(*) FROM f LEFT JOIN q ON f.s = q.id GROUP BY ALL""")
def index_item_counts(spark: SparkSession, d: str) -> DataFrame:
    """Passages and facts accepted into an index, and why others are not."""
    p = table(spark, d, "passage_candidates").select(uuid_key(F.col("source_span_id")).alias("id"), "start_char", "end_char", "content", "text_hash").distinct()
    spans = p.select("id", F.col("id").alias("document_version_id"), F.lit(0).alias("start_char"), (F.col("end_char") - F.col("start_char")).alias("end_char"), "text_hash")
    texts = p.select(F.col("id").alias("document_version_id"), F.col("content").alias("text"))
    f = facts(spark, d).select("id", uuid_key(F.col("source_span_id")).alias("source_span_id")).where("source_span_id is not null")
    items, rejected = I.index_items(spans, texts, f, "v1")
    both = items.select("kind", F.lit("accepted").alias("outcome")).unionByName(rejected.select("kind", F.col("code").alias("outcome")))
    return both.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT e.item_id AS quote_id, regexp_replace(d.accession, '[^0-9]', '', 'g') AS accession, count(DISTINCT d.doc_id) AS n, min(d.doc_id) AS s FROM eval_items e JOIN documents d ON e.text <> '' AND contains(d.text, e.text) GROUP BY ALL)
  SELECT e.item_id AS quote_id, accession, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN s END AS span_id, CASE WHEN n IS NULL THEN 'UNRESOLVED_QUOTE' WHEN n > 1 THEN 'AMBIGUOUS_QUOTE' END AS code FROM (SELECT DISTINCT item_id FROM eval_items) e LEFT JOIN h ON e.item_id = h.quote_id""")
def quote_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Whole evaluation items looked for in the texts of all documents, resolved within each accession that holds one."""
    texts = table(spark, d, "documents").where("text is not null").select(accession_key(F.col("accession")).alias("accession"), F.col("doc_id").alias("span_id"), "text")
    return B.quote_scopes(table(spark, d, "eval_items").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), texts)


AS_OF_SQL = "CAST(CASE WHEN length(trim(as_of)) = 10 THEN trim(as_of) || 'T00:00:00Z' ELSE trim(as_of) END AS TIMESTAMPTZ)"


@query(f"""WITH m AS (SELECT DISTINCT id, regexp_replace(a, '[^0-9]', '', 'g') AS accession, {AS_OF_SQL} AS t FROM (SELECT id, as_of, unnest(documents_reviewed) AS a FROM manifest_entries)),
  d AS (SELECT regexp_replace(accession, '[^0-9]', '', 'g') AS accession, min(published_at) AS p FROM documents GROUP BY 1)
  SELECT id, m.accession, CASE WHEN p IS NULL THEN 'UNKNOWN_ACCESSION' WHEN NOT (CASE WHEN date_trunc('day', p AT TIME ZONE 'UTC') = p AT TIME ZONE 'UTC' THEN p + INTERVAL 1 DAY <= t ELSE p <= t END) THEN 'EVIDENCE_AFTER_CUTOFF' END AS code FROM m LEFT JOIN d ON m.accession = d.accession""")
def temporal_leakage(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.plans.problems import reviewed

    accepted = table(spark, d, "documents").groupBy(accession_key(F.col("accession")).alias("accession")).agg(F.min("published_at").alias("p"))
    m = reviewed(spark, d).distinct().join(accepted, "accession", "left")
    return m.select("id", "accession", B.temporal_codes(F.col("p"), F.col("as_of"), F.lit("evidence")).alias("code"))


@query("""WITH c AS (SELECT run_id, item_id, min(lane_rank) AS r, bool_or(kind = 'fact') AS rel FROM lane_candidates WHERE lane = 'lexical' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY r, item_id) AS rank FROM c),
  g AS (SELECT run_id, coalesce(max(CASE WHEN rel AND rank <= 10 THEN 1.0 / rank END), 0) AS mrr, count(*) FILTER (rel AND rank <= 10) / 10 AS p, coalesce(sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1.0) END), 0) AS dcg, count(*) FILTER (rel) AS n FROM k GROUP BY 1)
  SELECT run_id, round(mrr, 6) AS mrr, round(p, 6) AS precision, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0.0 END, 6) AS ndcg FROM g""")
def rank_quality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").where("lane = 'lexical'").groupBy("run_id", "item_id").agg(F.min("lane_rank").alias("r"), F.bool_or(F.col("kind") == "fact").alias("rel"))
    return B.rank_metrics(R.ranked(c, ["run_id"], [F.col("r"), F.col("item_id")]), "run_id", "rank", "rel", 10)


DAILY_SQL = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 6) AS total FROM events GROUP BY ALL)"


@query(f"""WITH {DAILY_SQL}, f AS (SELECT *, lag(total, 7) OVER (PARTITION BY event_type ORDER BY day) AS fc FROM d)
  SELECT event_type, count(*) AS n, round(avg(abs(total - fc)), 4) AS mae, round(sqrt(avg((total - fc) * (total - fc))), 4) AS rmse, round(avg(2 * abs(total - fc) / (abs(total) + abs(fc))), 4) AS smape FROM f WHERE fc IS NOT NULL GROUP BY 1""")
def seasonal_backtest(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("total"))
    e = B.forecast_errors(B.naive_forecast(daily, "event_type", "day", "total", 7), "event_type", "total")
    return e.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "smape")})


@query("""WITH m AS (SELECT user_id, ts, event_type, event_type IS DISTINCT FROM lag(event_type) OVER w AS new FROM (SELECT DISTINCT user_id, ts, event_type FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5('{"event_type":"' || event_type || '"}'))),
  k AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, md5('{"event_type":"' || event_type || '"}') ROWS UNBOUNDED PRECEDING) AS version FROM m), g AS (SELECT user_id, version, min(ts) AS valid_from, count(*) AS snapshots, min(event_type) AS event_type FROM k GROUP BY ALL)
  SELECT user_id, CAST(version AS BIGINT) AS version, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, snapshots, event_type, strftime(lead(valid_from) OVER (PARTITION BY user_id ORDER BY version), '%Y-%m-%d %H:%M:%S') AS valid_to FROM g""")
def user_state_history(spark: SparkSession, d: str) -> DataFrame:
    h = snapshots_history(table(spark, d, "events").select("user_id", "ts", "event_type"), ["user_id"], "ts", ["event_type"])
    return h.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("valid_from", "valid_to")})


@query("SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM (SELECT DISTINCT id, document_version_id, ord FROM sections) WINDOW w AS (PARTITION BY document_version_id ORDER BY ord, id)")
def outline_neighbours(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("id", "document_version_id", "ord").distinct()
    w = Window.partitionBy("document_version_id").orderBy("ord", "id")
    return s.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


@query("SELECT f.id, s.value, d.value AS restated_value FROM (SELECT DISTINCT id, restates FROM financial_facts WHERE restates IS NOT NULL) f JOIN (SELECT DISTINCT id, value FROM financial_facts) s ON f.id = s.id LEFT JOIN (SELECT DISTINCT id, value FROM financial_facts) d ON f.restates = d.id")
def restated_values(spark: SparkSession, d: str) -> DataFrame:
    """Left join that keeps restatements whose original isn't in the table."""
    f = facts(spark, d)
    return f.where("restates is not null").select("id", "value", F.col("restates").alias("o")).join(f.select(F.col("id").alias("o"), F.col("value").alias("restated_value")), "o", "left").drop("o")


@query("SELECT id, CASE WHEN restates IN (SELECT id FROM financial_facts WHERE entity_id = f.entity_id) THEN restates END AS restates FROM (SELECT DISTINCT id, entity_id, restates FROM financial_facts) f")
def link_closure(spark: SparkSession, d: str) -> DataFrame:
    """Links to facts that aren't among the same entity's are nulled."""
    f = facts(spark, d).select("id", "entity_id", "restates")
    there = f.select("entity_id", F.col("id").alias("restates"), F.lit(True).alias("there"))
    return f.join(there, ["entity_id", "restates"], "left").select("id", F.when(F.col("there"), F.col("restates")).alias("restates"))


@query("SELECT DISTINCT doc_id, CAST(CAST(t.published_at AT TIME ZONE 'UTC' AS DATE) - 1 AS VARCHAR) AS vintage_day FROM documents t")
def vintage_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.vintage_day(F.col("published_at")).cast("string").alias("vintage_day"))


@query()
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the tables in documents with markup."""
    docs = table(spark, d, "documents").where(F.col("text").contains("<")).select("doc_id", "text")
    return table_rows(parse_documents(docs.withColumnRenamed("text", "html"), "doc_id", "html"), "doc_id").withColumn("cells", F.array_join("cells", " | "))


@query("""SELECT c_custkey, c_nationkey, r_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def customer_orders(spark: SparkSession, d: str) -> DataFrame:
    """Semi-reduced star join; orders are combined before they meet the customers."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(o, "c_custkey", "left").select("c_custkey", "c_nationkey", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


HEADER = """<html><head><title>t</title></head><body><ix:header><ix:resources>
<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="cik">0000000042</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:identifier scheme="cik">0000000042</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="x:Region">x:East</xbrldi:explicitMember><xbrldi:explicitMember dimension="x:Line">x:Wood</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="c3"><xbrli:entity><xbrli:identifier>42</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="u2"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<xbrli:unit id="u3"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit></ix:resources></ix:header>"""

#: What stands in a document, and (value, unit, period, dims, code) of the fact in it.
INLINE = (
    ('unitRef="u1" contextRef="c1" scale="6">1,234.5<', "1234500000", "USD", "2023-01-01/2023-12-31", "", None),
    ('unitRef="u1" contextRef="c1" scale="3" format="ixt:num-comma-decimal">(1.234,56)<', "-1234560", "USD", "2023-01-01/2023-12-31", "", None),
    ('unitRef="u2" contextRef="c1" sign="-">(0.42)<', "0.42", "USD/shares", "2023-01-01/2023-12-31", "", None),
    ('unitRef="u3" contextRef="c2" sign="-">12<', "-12", "pure", "2023-12-31", "x:Line=x:Wood;x:Region=x:East", None),
    ('unitRef="u1" contextRef="c2">—<', "0", "USD", "2023-12-31", "x:Line=x:Wood;x:Region=x:East", None),
    ('unitRef="u1" contextRef="c1" format="ixt:numdash">none<', "0", "USD", "2023-01-01/2023-12-31", "", None),
    ('unitRef="u1" contextRef="c1" format="ixt:num-unit-decimal">1,250<', None, "USD", "2023-01-01/2023-12-31", "", "UNKNOWN_FORMAT"),
    ('unitRef="u1" contextRef="c1" format="ixt:fixed-empty">5<', None, "USD", "2023-01-01/2023-12-31", "", "EMPTY_FACT_VALUE"),
    ('unitRef="u1" contextRef="c1">NaN<', None, "USD", "2023-01-01/2023-12-31", "", "NONFINITE_FACT_VALUE"),
    ('unitRef="u1" contextRef="c1">see note<', None, "USD", "2023-01-01/2023-12-31", "", "BAD_NUMBER"),
    ('unitRef="u1" contextRef="c9">5<', None, "USD", None, None, "UNKNOWN_CONTEXT"),
    ('unitRef="u9" contextRef="c1">5<', None, None, "2023-01-01/2023-12-31", "", "UNKNOWN_UNIT"),
    ('unitRef="u1" contextRef="c3">5<', None, "USD", None, "", "BAD_PERIOD"),
)


def _told(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_told, want))})" for i, (_, *want) in enumerate(INLINE)) + ") t(doc, value, unit, period, dims, code)")
def inline_facts(spark: SparkSession, d: str) -> DataFrame:
    """Inline facts of filings in HTML, through their contexts and units to values in full."""
    rows = [(i, f'{HEADER}<p>We earned <ix:nonFraction name="x:Revenue" {x}/ix:nonFraction>.</p></body></html>') for i, (x, *_) in enumerate(INLINE)]
    parsed = parse_documents(spark.createDataFrame(rows, "doc int, html string"), "doc", "html")
    return I.inline_facts(parsed, "doc").select("doc", "value", "unit", "period", "dims", "code")
