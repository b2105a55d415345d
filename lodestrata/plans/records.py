"""Queries over texts, payloads, events, streams and time series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import texts as X
from lodestrata.operators import claims as C
from lodestrata.operators import payloads as P
from lodestrata.plans.registry import Registry
from lodestrata.plans.tables import remove_path, shared_folder, table
from lodestrata.streaming import events as E

query = Registry()
KPI_SQL = "k AS (SELECT DISTINCT * FROM kpi_payloads)"


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kpi_payloads").distinct()


def intent_sql(c: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({c}), '(^|\\W)({'|'.join(w)})(\\W|$)') THEN '{n}'" for n, w in X.INTENTS)
    return f"CASE {cases} ELSE 'general' END"


@query(f"SELECT id, {intent_sql('question')} AS intent FROM (SELECT DISTINCT id, question FROM manifest_entries)")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_entries").select("id", "question").distinct().select("id", X.intent(F.col("question")).alias("intent"))


SYNONYMS = {"revenue": "net sales", "expense": "cost", "develop": "evolve"}


@query("""SELECT id, array_to_string(list_distinct_ordered, ' | ') AS variants FROM (SELECT id, list_filter([question,
  CASE WHEN regexp_matches(lower(question), '\\brevenue\\b') THEN regexp_replace(question, '\\brevenue\\b', 'net sales', 'i') END,
  CASE WHEN regexp_matches(lower(question), '\\bexpense\\b') THEN regexp_replace(question, '\\bexpense\\b', 'cost', 'i') END,
  CASE WHEN regexp_matches(lower(question), '\\bdevelop\\b') THEN regexp_replace(question, '\\bdevelop\\b', 'evolve', 'i') END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT DISTINCT id, question FROM manifest_entries))""")
def synonym_variants(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest_entries").select("id", "question").distinct()
    return m.select("id", F.array_join(X.variants(F.col("question"), SYNONYMS), " | ").alias("variants"))


def variants_sql(c: str) -> str:
    each = ", ".join(f"regexp_replace({c}, '(?i)(^|\\W){w}(\\W|$)', '\\1{o}\\2')" for w, others in X.SYNONYMS.items() for o in others)
    return f"[{c}, {each}]"


@query(f"""SELECT DISTINCT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ' | ') AS variants FROM (SELECT id, {variants_sql('q')} AS l FROM (SELECT id, replace(replace(question, 'income', 'net income'), 'amount', 'revenue') AS q FROM manifest_entries))""")
def question_variants(spark: SparkSession, d: str) -> DataFrame:
    """Questions, with words of the table worked in, in up to four wordings."""
    q = F.replace(F.replace("question", F.lit("income"), F.lit("net income")), F.lit("amount"), F.lit("revenue"))
    return table(spark, d, "manifest_entries").select("id", F.array_join(X.variants(q, X.SYNONYMS), " | ").alias("variants")).distinct()


@query(r"SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '''[^'']*''', '''?''', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), 256) AS redacted FROM documents WHERE text IS NOT NULL")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query("SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_words, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_tokens FROM eval_items")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    return e.select("item_id", F.size(C.token_set(F.col("text"))).cast("bigint").alias("n_words"), X.approx_tokens(F.col("text")).cast("bigint").alias("n_tokens"))


@query("""SELECT id, CASE WHEN v = 0 THEN '0e0' ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || rtrim(ltrim(replace(replace(value, '-', ''), '.', ''), '0'), '0') || 'e' ||
  CAST(coalesce(scale, 0) - CASE WHEN contains(value, '.') THEN length(split_part(value, '.', 2)) ELSE 0 END + length(replace(value, '.', '')) - length(rtrim(replace(value, '.', ''), '0')) AS VARCHAR) END AS magnitude
  FROM (SELECT DISTINCT id, value, scale, CAST(value AS DOUBLE) AS v FROM financial_facts)""")
def canonical_magnitude(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts").select("id", "value", "scale").distinct()
    return f.select("id", P.canonical_magnitude(F.col("value"), F.col("scale")).alias("magnitude"))


@query(f"WITH {KPI_SQL} SELECT id, CASE WHEN TRY_CAST(value AS DOUBLE) > 0 THEN 'positive' WHEN TRY_CAST(value AS DOUBLE) < 0 THEN 'negative' WHEN TRY_CAST(value AS DOUBLE) = 0 THEN 'zero' END AS sign FROM k")
def payload_sign(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("id", P.sign_of(F.col("value")).alias("sign"))


@query(f"""WITH {KPI_SQL} SELECT id, CASE WHEN trim(entity_id) <> '' AND trim(metric_id) <> '' AND trim(unit) <> '' THEN 'entity_id=' || trim(entity_id) || '|metric_id=' || trim(metric_id) || '|unit=' || trim(unit) END AS comparability FROM k""")
def comparability(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("id", P.comparability_key(["entity_id", "metric_id", "unit"]).alias("comparability"))


@query(f"""WITH {KPI_SQL} SELECT entity_id, metric_id, CAST(period_end AS VARCHAR) AS period_end, count(DISTINCT id) AS n_members, count(DISTINCT raw_value) AS n_values, CASE WHEN count(DISTINCT raw_value) > 1 THEN 'conflict' ELSE 'duplicate' END AS kind
  FROM k WHERE raw_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1""")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return P.conflict_groups(payloads(spark, d).where("raw_value is not null"), ["entity_id", "metric_id", "period_end"], "id", "raw_value").withColumn("period_end", F.col("period_end").cast("string"))


@query("SELECT sha256(text) AS digest, min(id) AS first_id, count(DISTINCT id) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 1")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("id", F.sha2("text", 256).alias("digest"))
    return P.duplicate_groups(docs, ["digest"], "id")


@query("""SELECT l_orderkey, round(sum(l_extendedprice), 4) AS parts, max(o_totalprice) AS total, count(*) AS n_parts, abs(round(sum(l_extendedprice), 4) - max(o_totalprice)) <= greatest(abs(round(sum(l_extendedprice), 4)), abs(max(o_totalprice))) * 0.005 AS balanced
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 1""")
def segments_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return P.segments_total(rows, ["l_orderkey"], F.col("l_extendedprice"), F.col("o_totalprice"))


@query("""SELECT l_orderkey, abs(net - (gross - abs(given))) <= greatest(abs(net), abs(gross - abs(given))) * 0.005 AS balanced FROM (SELECT l_orderkey, sum(l_extendedprice) AS gross, sum(l_extendedprice * l_discount) AS given,
  sum(l_extendedprice * (1 - l_discount)) + count(*) FILTER (l_returnflag = 'R') * 100 AS net FROM lineitem GROUP BY 1)""")
def net_price_identity(spark: SparkSession, d: str) -> DataFrame:
    """net = gross - |discount| of each order, with an error planted where lines were returned."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("gross"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("given"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + F.count_if(F.col("l_returnflag") == "R") * 100).alias("net"),
    )
    rows = per.unpivot(["l_orderkey"], ["gross", "given", "net"], "metric", "value")
    return P.identity_balance(rows, ["l_orderkey"], "metric", "value", "net", "gross", "given").select("l_orderkey", "balanced")


@query(f"""WITH {KPI_SQL} SELECT id, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'missing_value' END, CASE WHEN unit IS NULL THEN 'missing_unit' END, CASE WHEN unit = 'percent' AND abs(TRY_CAST(value AS DOUBLE)) > 1000 THEN 'percent_bounds' END,
  CASE WHEN period_end IS NULL THEN 'missing_period' END], lambda x: x IS NOT NULL), ',') AS errors FROM k""")
def payload_errors(spark: SparkSession, d: str) -> DataFrame:
    checks = {"missing_value": F.col("value").isNull(), "missing_unit": F.col("unit").isNull(), "percent_bounds": (F.col("unit") == "percent") & (F.abs(F.col("value").try_cast("double")) > 1000), "missing_period": F.col("period_end").isNull()}
    return payloads(spark, d).select("id", F.array_join(P.payload_errors(checks), ",").alias("errors"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'v'))), ',') AS unknown FROM events")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.array_join(P.unknown_keys(F.col("props"), ["k", "v"]), ",").alias("unknown"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    t = E.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"], "value")
    return t.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) GROUP BY 1""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    t = E.tumbling(table(spark, d, "events"), "ts", "12 hours", [], "value", slide="6 hours")
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT user_id, ts FROM events)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o), b AS (SELECT user_id, k, min(ts) AS started, max(ts) + INTERVAL '6 hours' AS ended FROM s GROUP BY ALL)
  SELECT b.user_id, started, ended, count(*) AS n FROM b JOIN events e ON e.user_id = b.user_id AND e.ts >= started AND e.ts < ended GROUP BY ALL""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = E.sessions(table(spark, d, "events"), ["user_id"], "ts", "6 hours")
    return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("SELECT user_id, max(ts) AS heartbeat_at FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def stale_users(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat_at")).withColumn("status", F.lit("running"))
    now = F.lit("2024-01-30 12:01:00").cast("timestamp")
    return E.stale(jobs, now).select("user_id", F.col("heartbeat_at").cast("timestamp_ntz").alias("heartbeat_at"))


@query("""SELECT run_id, lane_rank AS seq, expected FROM (SELECT run_id, lane_rank, coalesce(lag(lane_rank) OVER (PARTITION BY run_id ORDER BY lane_rank), 0) + 1 AS expected FROM (SELECT DISTINCT run_id, lane_rank FROM lane_candidates)) WHERE lane_rank <> expected""")
def event_seq_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lane_candidates").select("run_id", F.col("lane_rank").alias("seq")).distinct()
    return E.gaps(e, "run_id", "seq")


STEPS = {"view": ("view", "click"), "click": ("click", "signup", "view"), "signup": ("purchase", "view"), "purchase": ("view",)}


@query(f"""SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
  WHERE NOT (CASE WHEN before IS NULL THEN event_type = 'view' ELSE {' OR '.join(f"(before = '{a}' AND event_type IN ({', '.join(repr(t) for t in to)}))" for a, to in STEPS.items())} END)""")
def event_status_fsm(spark: SparkSession, d: str) -> DataFrame:
    return E.illegal_steps(table(spark, d, "events"), "user_id", "event_id", "event_type", STEPS)


@query("SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m")
def sequence_gate(spark: SparkSession, d: str) -> DataFrame:
    return E.accepted(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id")


def streamed(spark: SparkSession, d: str, name: str, plan) -> DataFrame:
    """A table read as a stream, put through ``plan`` until nothing is left, and read back."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # a stream reads folders, so a table that is one file is matched by a pattern
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parque[t]")
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = plan(source)
    E.run_available(out, f"{folder}/out", f"{folder}/state")
    remove_path(spark, f"{folder}/state")  # all there is has been read; nothing resumes from it
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("SELECT event_id, user_id FROM events WHERE event_id > 1000")
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, "events", lambda e: E.replay(e, F.lit(1000), "event_id").select("event_id", "user_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, "events", lambda e: E.first_per_key(e.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "60 days").drop("ts"))


@query("SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL")
def user_activity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return e.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})
