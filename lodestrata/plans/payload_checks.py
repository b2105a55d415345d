"""Queries over payloads and values: canonical forms, digests, shapes, accounting and definition checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import texts as X
from lodestrata.functions.ids import accession_key
from lodestrata.functions.vectors import mock_embedding
from lodestrata.operators import benchmark as B
from lodestrata.operators import payloads as P
from lodestrata.plans.records import KPI_SQL, payloads
from lodestrata.plans.registry import Registry
from lodestrata.plans.tables import table

query = Registry()


@query(f"WITH {KPI_SQL} SELECT DISTINCT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS proposal_id FROM (SELECT id, sha256(id || '|' || coalesce(metric_id, '')) AS h FROM k)")
def proposal_ids(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("id", P.digest_uuid(F.concat("id", F.lit("|"), F.coalesce("metric_id", F.lit("")))).alias("proposal_id")).distinct()


@query(f"WITH {KPI_SQL} SELECT DISTINCT id, sha256(CAST(to_json({{'currency': currency, 'metric_id': metric_id, 'scale': scale, 'value': value}}) AS VARCHAR)) AS step_hash FROM k")
def step_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a step's input in canonical JSON: sorted keys, no blanks, numbers kept as they are written."""
    return payloads(spark, d).select("id", P.canonical_hash(["value", "metric_id", "scale", "currency"]).alias("step_hash")).distinct()


@query(f"WITH {KPI_SQL} SELECT DISTINCT id, sha256(CAST(to_json({{'p0': value, 'p1': unit, 'p2': metric_id}}) AS VARCHAR)) AS fingerprint FROM k")
def value_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("id", P.fingerprint(F.col("value"), F.col("unit"), F.col("metric_id")).alias("fingerprint")).distinct()


@query("SELECT DISTINCT id, array_to_string(list_transform(list_sort(map_entries(dimensions)), lambda e: e.key || '=' || trim(e.value)), ';') AS dims FROM financial_facts")
def sorted_dimensions(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.map_entries(P.sorted_map(F.col("dimensions")))
    return table(spark, d, "financial_facts").select("id", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("dims")).distinct()


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown FROM orders")
def grouped_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.grouped(F.floor("o_totalprice")).alias("shown"))


@query("""SELECT DISTINCT id, CASE WHEN period_type = 'instant' AND period_instant IS NOT NULL AND period_start IS NULL THEN CAST(period_instant AS VARCHAR) WHEN period_type = 'duration' AND period_instant IS NULL AND period_start <= period_end THEN period_start || '/' || period_end END AS period,
  CASE WHEN period_type = 'instant' AND period_instant IS NOT NULL AND period_start IS NULL THEN NULL WHEN period_type = 'duration' AND period_instant IS NULL AND period_start <= period_end THEN NULL ELSE 'BAD_PERIOD' END AS code FROM financial_facts""")
def period_shapes(spark: SparkSession, d: str) -> DataFrame:
    p = P.period_text(F.col("period_type"), F.col("period_instant"), F.col("period_start"), F.col("period_end"))
    return table(spark, d, "financial_facts").select("id", p.alias("period"), F.when(p.isNull(), "BAD_PERIOD").alias("code")).distinct()


@query("SELECT doc_id, translate(rtrim(to_base64(encode(accession)), '='), '+/', '-_') AS token, accession AS decoded FROM documents WHERE accession IS NOT NULL")
def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Texts as base64url tokens, and read back from them."""
    t = table(spark, d, "documents").where("accession is not null").select("doc_id", X.url_token(F.col("accession")).alias("token"))
    return t.withColumn("decoded", X.from_url_token(F.col("token")))


@query(f"WITH {KPI_SQL} SELECT DISTINCT id, CASE WHEN trim(coalesce(value, '')) = trim(coalesce(raw_value, '')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM k")
def exact_matches(spark: SparkSession, d: str) -> DataFrame:
    same = F.trim(F.coalesce("value", F.lit(""))) == F.trim(F.coalesce("raw_value", F.lit("")))
    return payloads(spark, d).select("id", F.when(same, 1.0).otherwise(0.0).alias("score")).distinct()


@query("SELECT doc_id, left(regexp_replace(accession, '[^0-9]', '', 'g'), 10) || '-' || strftime(published_at AT TIME ZONE 'UTC', '%Y%m%d') || '-' || left(sha256(coalesce(text, '')), 8) AS snapshot_id FROM documents WHERE regexp_replace(accession, '[^0-9]', '', 'g') <> '' AND published_at IS NOT NULL")
def snapshot_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("__a", accession_key(F.col("accession"))).where("__a is not null and published_at is not null")
    return docs.select("doc_id", F.concat_ws("-", F.left("__a", F.lit(10)), F.date_format("published_at", "yyyyMMdd"), F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(8))).alias("snapshot_id"))


RATIOS = ("nrr", "grr", "svc_gm", "sub_gm")
RATIO_UNITS = ("percent", "pct", "%")


@query(f"""WITH {KPI_SQL} SELECT DISTINCT id, array_to_string(list_filter([CASE WHEN metric_id IN {RATIOS} AND lower(unit) IN {RATIO_UNITS} AND abs(TRY_CAST(value AS DOUBLE)) > 100 THEN 'PERCENT_BOUNDS' END,
  CASE WHEN metric_id IN ('seats', 'cust_total', 'cust_threshold') AND TRY_CAST(value AS DOUBLE) < 0 THEN 'NEGATIVE_COUNT' END, CASE WHEN metric_id IN {RATIOS} AND currency IS NOT NULL THEN 'RATIO_WITH_CURRENCY' END], lambda x: x IS NOT NULL), ',') AS codes FROM k""")
def accounting_codes(spark: SparkSession, d: str) -> DataFrame:
    v, m = F.col("value").try_cast("double"), F.col("metric_id")
    checks = {
        "PERCENT_BOUNDS": m.isin(*RATIOS) & F.lower("unit").isin(*RATIO_UNITS) & (F.abs(v) > 100),
        "NEGATIVE_COUNT": m.isin("seats", "cust_total", "cust_threshold") & (v < 0), "RATIO_WITH_CURRENCY": m.isin(*RATIOS) & F.col("currency").isNotNull(),
    }
    return payloads(spark, d).select("id", F.array_join(P.payload_errors(checks), ",").alias("codes")).distinct()


#: Kinds of units by their labels, and the kind each metric is measured in (money, if it isn't here).
UNIT_KINDS = {"ratio": ("percent", "pct", "%", "pure", "bps", "basis points", "ratio"), "time": ("days", "hours", "weeks", "d", "wk", "hrs"), "count": ("count", "customers", "seats", "customers (000s)", "seats (000s)", "thousands of customers", "thousands of seats")}
METRIC_KINDS = {"ratio": RATIOS, "time": ("dso",), "count": ("seats", "cust_total", "cust_threshold")}


def _kind(column: str, kinds: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(repr(v) for v in names)}) THEN '{k}'" for k, names in kinds.items()) + " ELSE 'money' END"


@query(f"WITH {KPI_SQL} SELECT DISTINCT id, CASE WHEN unit IS NOT NULL AND {_kind('lower(unit)', UNIT_KINDS)} <> {_kind('metric_id', METRIC_KINDS)} THEN 'UNIT_MISMATCH' END AS code FROM k")
def definition_units(spark: SparkSession, d: str) -> DataFrame:
    """Payloads whose unit isn't of the kind their metric is defined in."""
    return payloads(spark, d).select("id", P.unit_mismatch(F.col("metric_id"), F.col("unit"), METRIC_KINDS, UNIT_KINDS, "money").alias("code")).distinct()


@query(f"WITH {KPI_SQL} SELECT entity_id, metric_id, min(coalesce(scale, 0)) AS scale, count(DISTINCT id) AS n FROM k GROUP BY ALL")
def common_scales(spark: SparkSession, d: str) -> DataFrame:
    """The smallest exponent among the values of a metric, to which all can be brought."""
    return payloads(spark, d).groupBy("entity_id", "metric_id").agg(F.min(F.coalesce("scale", F.lit(0))).alias("scale"), F.countDistinct("id").alias("n"))


@query(f"""WITH {KPI_SQL}, g AS (SELECT metric_id, unit, raw_value, min(id) AS group_id FROM k WHERE raw_value IS NOT NULL AND unit IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1)
  SELECT DISTINCT k.id, g.group_id FROM k JOIN g ON k.metric_id = g.metric_id AND k.unit = g.unit AND k.raw_value = g.raw_value""")
def duplicate_index(spark: SparkSession, d: str) -> DataFrame:
    """The group of each payload that others repeat."""
    keys = ["metric_id", "unit", "raw_value"]
    k = payloads(spark, d)
    return k.join(P.duplicate_groups(k, keys, "id"), keys).select("id", F.col("first_id").alias("group_id")).distinct()


@query("SELECT DISTINCT id, trim(regexp_replace(regexp_replace(question, '</?[A-Za-z][^<>]*>|[`{}<>]', ' ', 'g'), ' +', ' ', 'g')) AS cleaned FROM manifest_entries")
def cleaned_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_entries").select("id", X.without_markup(F.col("question")).alias("cleaned")).distinct()


@query("SELECT DISTINCT id, array_to_string(list_filter(list_transform(string_split_regex(question, '[,\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM manifest_entries")
def question_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_entries").select("id", F.array_join(X.listed(F.col("question")), "|").alias("parts")).distinct()


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced FROM eval_items")
def spaced_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", X.spaced(F.col("text")).alias("spaced"))


@query("SELECT l_orderkey, l_linenumber, round(l_linenumber / l_quantity, 12) AS ratio FROM lineitem")
def parsed_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios written as a / b, read back."""
    l = table(spark, d, "lineitem")  # noqa: E741
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(" / "), F.col("l_quantity").cast("string"))
    return l.select("l_orderkey", "l_linenumber", B.parsed_ratio(text).alias("ratio"))


@query("SELECT n_nationkey, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM (SELECT n_nationkey, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT n_nationkey, list_transform(range(64), lambda i: CAST(('0x' || substr(sha256(n_name || '|' || (i // 32)), (i % 32) * 2 + 1, 2)) AS INTEGER) - 127.5::DOUBLE) AS v FROM nation))")
def mock_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "nation").select("n_nationkey", mock_embedding(F.col("n_name"), 64).alias("v"))
    return v.select("n_nationkey", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("""SELECT l_orderkey, abs(p) <= abs(w) OR abs(abs(p) - abs(w)) <= greatest(abs(p), abs(w)) * 0.005 AS within FROM (SELECT l_orderkey, sum(l_quantity) * 1500 AS p, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1)""")
def part_within_whole(spark: SparkSession, d: str) -> DataFrame:
    """Is the part no more than the whole, half a percent aside?"""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") * 1500).cast("double").alias("part"), F.sum("l_extendedprice").cast("double").alias("whole"))
    return P.part_within_whole(per.unpivot(["l_orderkey"], ["part", "whole"], "metric", "value"), ["l_orderkey"], "metric", "value", "part", "whole")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k:REQUIRED' END, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 90 THEN 'k:MAXIMUM' END, CASE WHEN json_extract(props, '$.v') IS NULL THEN 'v:REQUIRED' END], lambda x: x IS NOT NULL), ',') AS errors FROM events""")
def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """JSON against a schema: required keys, types, bounds, choices, lengths."""
    schema = {"type": "object", "required": ["k", "v"], "properties": {"k": {"type": "integer", "maximum": 90}, "v": {"type": "string", "minLength": 1}}}
    return table(spark, d, "events").select("event_id", F.array_join(P.schema_errors(F.col("props"), schema), ",").alias("errors"))


SECRETS = (
    ("Authorization: Bearer abc.def.ghi", "Authorization: ***"), ("Authorization=Basic dXNlcjpwYXNz", "Authorization=***"), ("Bearer sk-live-SECRET", "***"), ("api_key=SECRET123", "api_key=***"),
    ("API-Key: SECRET123", "API-Key: ***"), ("password: hunter2", "password: ***"), ("x token=abc123; y", "x token=***; y"), ('{"api_key": "se cret"} left', '{"?": ***} left'), ('bad value "confidential filing text"', 'bad value "?"'),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{shown.replace(chr(39), chr(39) * 2)}')" for i, (_, shown) in enumerate(SECRETS)) + ") t(id, redacted)")
def redacted_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Credentials in all the ways messages carry them."""
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(SECRETS)], "id int, text string")
    return rows.select("id", X.redact(F.col("text"), strict=True).alias("redacted"))
