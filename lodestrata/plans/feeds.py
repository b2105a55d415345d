"""Queries over what sources deliver: filing indexes, company facts, vintages, bars, queues, synthetic corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.vectors import dimension_errors
from lodestrata.operators import hierarchy as H
from lodestrata.plans.problems import section_id, section_links
from lodestrata.plans.problems_sql import TREE, spelled
from lodestrata.plans.registry import Registry
from lodestrata.plans.tables import table
from lodestrata.sources import filings as S
from lodestrata.sources.synthetic import FORMS, SPACE, synthetic_filings
from lodestrata.streaming import events as E

query = Registry()


@query("""SELECT doc_id, lpad(left(regexp_replace(accession, '[^0-9]', '', 'g'), 10), 10, '0') AS cik, accession, form, CAST(CAST(filed_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS filed_on, filed_at IS NULL AS bad_date,
  'https://filings.example/' || regexp_replace(lpad(left(regexp_replace(accession, '[^0-9]', '', 'g'), 10), 10, '0'), '^0+', '') || '/' || replace(accession, '-', '') || '/' || doc_id || '.htm' AS url FROM documents WHERE regexp_replace(accession, '[^0-9]', '', 'g') <> ''""")
def filing_index(spark: SparkSession, d: str) -> DataFrame:
    """The filings of an index of parallel arrays; here every document has an index of its own."""
    docs = table(spark, d, "documents").withColumn("__a", F.regexp_replace("accession", "[^0-9]", "")).where("__a <> ''")
    one = lambda c: F.array(c.cast("string"))
    recent = F.struct(one(F.col("accession")).alias("accessionNumber"), one(F.col("form")).alias("form"), one(F.coalesce(F.to_date("filed_at").cast("string"), F.lit("soon"))).alias("filingDate"), F.array(F.concat(F.col("doc_id").cast("string"), F.lit(".htm"))).alias("primaryDocument"))
    index = docs.select(F.left("__a", F.lit(10)).alias("cik"), F.struct(recent.alias("recent")).alias("filings"))
    out = S.filing_list(index).withColumn("doc_id", F.regexp_extract("url", r"([0-9]+)\.htm$", 1).cast("bigint"))
    return out.withColumn("filed_on", F.col("filed_on").cast("string"))


@query(r"""SELECT DISTINCT id, split_part(concept, ':', 1) AS taxonomy, split_part(concept, ':', 2) AS concept, unit, CASE WHEN period_start IS NULL THEN 'instant' ELSE 'duration' END AS period_type, CAST(coalesce(period_instant, period_end) AS VARCHAR) AS period_end,
  CASE WHEN value IS NULL THEN 'MISSING_VALUE' WHEN NOT regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?') THEN 'NON_FINITE_OR_TEXT' WHEN coalesce(period_instant, period_end) IS NULL THEN 'BAD_DATE' WHEN period_start > coalesce(period_instant, period_end) THEN 'BAD_PERIOD' END AS code
  FROM financial_facts WHERE unit IS NOT NULL""")
def company_facts(spark: SparkSession, d: str) -> DataFrame:
    """Observations of nested company facts: taxonomy, concept, unit, observation."""
    f = table(spark, d, "financial_facts").where("unit is not null").select("id", "concept", "unit", "value", "period_start", F.coalesce("period_instant", "period_end").alias("ended")).distinct()
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    obs = F.struct(text("period_start").alias("start"), text("ended").alias("end"), text("value").alias("val"), text("id").alias("accn"), F.lit(None).cast("int").alias("fy"), none.alias("fp"), none.alias("form"), none.alias("filed"), none.alias("frame"))
    body = F.struct(none.alias("label"), none.alias("description"), F.create_map("unit", F.array(obs)).alias("units"))
    nested = f.select(F.lit(1).cast("bigint").alias("cik"), F.create_map(F.split_part("concept", F.lit(":"), F.lit(1)), F.create_map(F.split_part("concept", F.lit(":"), F.lit(2)), body)).alias("facts"))
    out = S.company_observations(nested)
    return out.select(F.col("accession").alias("id"), "taxonomy", "concept", "unit", "period_type", F.col("period_end").cast("string").alias("period_end"), "code")


VINTAGES = "SELECT event_type AS series_id, CAST(ts AS DATE) AS published_on, CAST(ts AS DATE) - CAST(event_id % 5 AS INTEGER) AS observed_on, CASE WHEN event_id % 7 = 0 THEN '.' ELSE CAST(event_id AS VARCHAR) END AS value FROM events"


@query(f"SELECT series_id, CAST(observed_on AS VARCHAR) AS observed_on, CAST(arg_max(value, (published_on, value)) AS DOUBLE) AS value FROM ({VINTAGES}) WHERE published_on <= DATE '2024-01-20' AND value <> '.' GROUP BY ALL")
def series_known(spark: SparkSession, d: str) -> DataFrame:
    """Each observation of a series as published by a day."""
    day = F.to_date("ts")
    v = table(spark, d, "events").select(F.col("event_type").alias("series_id"), day.alias("published_on"), F.date_sub(day, (F.col("event_id") % 5).cast("int")).alias("observed_on"), F.when(F.col("event_id") % 7 == 0, ".").otherwise(F.col("event_id").cast("string")).alias("value"))
    known = S.series_known(v, F.lit("2024-01-20").cast("date"))
    return known.select("series_id", F.col("observed_on").cast("string").alias("observed_on"), F.col("value").cast("double").alias("value"))


@query("""WITH b AS (SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS day, value - 5 AS adjusted_close, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id END AS volume, CAST(event_id % 13 - 1 AS DOUBLE) AS dividend, CAST(event_id % 17 AS DOUBLE) AS split_factor FROM events),
  w AS (SELECT *, count(*) OVER (PARTITION BY ticker, day) AS n FROM b WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')
  SELECT event_id, CASE WHEN volume IS NULL OR adjusted_close IS NULL THEN 'MISSING_FIELD' WHEN adjusted_close <= 0 THEN 'BAD_PRICE' WHEN split_factor <= 0 THEN 'BAD_SPLIT' WHEN dividend < 0 THEN 'BAD_DIVIDEND' WHEN n > 1 THEN 'DUPLICATE_DAY' END AS code FROM w""")
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars in a range of days, and what is wrong with each."""
    n = F.col("event_id")
    bars = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("day"), (F.col("value") - 5).alias("adjusted_close"), F.when(n % 11 != 0, n).alias("volume"),
        (n % 13 - 1).cast("double").alias("dividend"), (n % 17).cast("double").alias("split_factor"),
    )
    return S.daily_bars(bars, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date")).select("event_id", "code")


_ENTITY = f"(SELECT sha1(unhex('{SPACE}') || encode('issuer:' || i)) AS h)"


@query(f"""SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lower(printf('%02x', (CAST('0x' || substr(h,17,2) AS INTEGER) & 63) | 128)) || substr(h,19,2) || '-' || substr(h,21,12) AS entity_id,
  lpad(CAST(i + 1 AS VARCHAR), 12, '0') AS cik, lpad(CAST(i + 1 AS VARCHAR), 10, '9') || '-24-' || lpad(CAST(f AS VARCHAR), 6, '0') AS accession, {list(FORMS)}[CAST((i + f) % {len(FORMS)} AS INTEGER) + 1] AS form,
  CAST(('0x' || substr(sha256('issuer:' || i || ':' || f), 1, 12)) AS BIGINT) % 1000000 AS value, i % 7 = 6 AS broken
  FROM (SELECT i, f, sha1(unhex('{SPACE}') || encode('issuer:' || i)) AS h FROM range(40) a(i) CROSS JOIN range(12) b(f))""")
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Filings of forty made-up issuers, which follow from their numbers alone."""
    return synthetic_filings(spark, 40, 12)


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY priority, ts, event_id) - 1 AS INTEGER) AS worker FROM (SELECT event_id, ts, user_id % 5 AS priority FROM events WHERE event_type = 'signup' ORDER BY priority, ts, event_id LIMIT 8)")
def job_claims(spark: SparkSession, d: str) -> DataFrame:
    """The jobs that eight free workers get: the lowest priority number first, then the oldest."""
    jobs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("user_id") % 5).alias("priority"), F.when(F.col("event_type") == "signup", "queued").otherwise("running").alias("status"), F.lit(0).alias("attempts"))
    return E.claims(jobs, 8).select(F.col("id").alias("event_id"), "worker")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type WHEN event_id % 6 < 5 THEN 'queued' ELSE 'failed' END AS status FROM events")
def job_retries(spark: SparkSession, d: str) -> DataFrame:
    """Failed jobs go back to the queue until they had five attempts."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"), (F.col("event_id") % 6).alias("attempts"))
    return e.select("event_id", E.after_failure(F.col("status"), F.col("attempts"), F.lit(5)).alias("status"))


@query("SELECT vec_id, CASE WHEN embedding IS NULL THEN 'MISSING_VECTOR' WHEN len(embedding) <> 64 THEN 'BAD_DIMENSIONS' END AS code FROM embeddings")
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", dimension_errors(F.col("embedding"), 64).alias("code"))


@query(f"""WITH RECURSIVE {TREE}, up AS (SELECT a.id, count(*) AS depth, max(CASE WHEN k.parent IS NULL THEN a.anc END) AS root FROM above a JOIN known k ON a.anc = k.id GROUP BY 1)
  SELECT {spelled('root')} AS root_id, {spelled('id')} AS section_id, CAST(depth AS INTEGER) AS below FROM up WHERE id NOT IN (SELECT id FROM lost)""")
def outline_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Everything below the roots of the outlines, by nested sets."""
    tree = H.hierarchy(section_links(spark, d, headings=False))
    found = H.descendants(tree, tree.where("depth = 0").select("id"))
    return found.select(section_id("ancestor").alias("root_id"), section_id("id").alias("section_id"), F.col("below").cast("int").alias("below"))
