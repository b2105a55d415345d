"""Corpus queries: visibility, versions, spans, amendments, constraints, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import uuid5, uuid_key
from lodestrata.operators import quality as Q
from lodestrata.operators import spans as S
from lodestrata.operators import temporal as T
from lodestrata.plans.problems_sql import key
from lodestrata.plans.registry import Registry
from lodestrata.plans.tables import table

query = Registry()


def as_of() -> Column:
    return F.lit("2022-06-30 12:00:00").cast("timestamp")


AS_OF_SQL = "TIMESTAMPTZ '2022-06-30 12:00:00+00'"
#: Namespace of the URL version-5 UUIDs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Document versions with comparable ids, repeated rows once."""
    v = table(spark, d, "document_versions").distinct()
    return v.withColumns({"id": uuid_key(F.col("id")), "document_id": uuid_key(F.col("document_id"))})


VERSIONS_SQL = f"v AS (SELECT DISTINCT {key('id')} AS id, {key('document_id')} AS document_id, parser_version, status, created_at FROM document_versions)"


@query(f"SELECT doc_id, form, source FROM documents WHERE published_at <= {AS_OF_SQL}")
def known_documents(spark: SparkSession, d: str) -> DataFrame:
    return T.known_by(documents(spark, d), as_of()).select("doc_id", "form", "source")


@query(f"WITH {VERSIONS_SQL} SELECT doc_id FROM documents WHERE published_at <= {AS_OF_SQL} AND EXISTS (SELECT 1 FROM v WHERE v.document_id = {key('documents.id')} AND status = 'parsed')")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    known = T.known_by(documents(spark, d), as_of()).select("doc_id", uuid_key(F.col("id")).alias("id"))
    return T.with_status(known, versions(spark, d)).select("doc_id")


@query(f"WITH {VERSIONS_SQL} SELECT document_id, id, parser_version FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id) n FROM v WHERE status = 'parsed') WHERE n = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return T.latest_versions(versions(spark, d)).select("document_id", "id", "parser_version")


def published_facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts").select("id", "fact_key", "duplicate_of", "value", F.col("ingested_at").alias("created_at"), uuid_key(F.col("document_version_id")).alias("version")).distinct()
    v = versions(spark, d).select(F.col("id").alias("version"), F.col("document_id").alias("__d"))
    docs = documents(spark, d).select(uuid_key(F.col("id")).alias("__d"), "form", "published_at")
    return f.join(v.join(docs, "__d"), "version").drop("__d")


FACTS_SQL = f"""{VERSIONS_SQL}, f AS (SELECT DISTINCT f.id, f.fact_key, f.duplicate_of, f.value, f.ingested_at AS created_at, d.form, d.published_at
  FROM financial_facts f JOIN v ON {key('f.document_version_id')} = v.id JOIN documents d ON {key('d.id')} = v.document_id)"""


@query(f"""WITH {FACTS_SQL} SELECT fact_key, id, value FROM (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY published_at DESC, created_at DESC, id) n FROM f
  WHERE duplicate_of IS NULL AND fact_key IS NOT NULL AND form IS DISTINCT FROM '8-K' AND published_at < {AS_OF_SQL}) WHERE n = 1""")
def prior_facts_asof(spark: SparkSession, d: str) -> DataFrame:
    return T.prior_facts(published_facts(spark, d), as_of(), "8-K").select("fact_key", "id", "value")


AMENDS_SQL = """d AS (SELECT id, entity_id, regexp_replace(form, '/A$', '') AS base, period_start, period_end, published_at, form LIKE '%/A' AS amended FROM documents),
links AS (SELECT a.id, arg_max(o.id, (o.published_at, o.id)) AS amends FROM d a JOIN d o ON a.entity_id = o.entity_id AND a.base = o.base AND a.period_start = o.period_start AND a.period_end = o.period_end
  AND ((NOT o.amended AND o.published_at <= a.published_at) OR (o.amended AND o.published_at < a.published_at)) WHERE a.amended GROUP BY a.id)"""


@query(f"WITH {AMENDS_SQL} SELECT id, amends FROM links")
def amendment_links(spark: SparkSession, d: str) -> DataFrame:
    return T.amendment_links(documents(spark, d))


@query(f"""WITH RECURSIVE {AMENDS_SQL}, walk(id, terminal, steps) AS (SELECT id, amends, 1 FROM links UNION ALL SELECT w.id, l.amends, w.steps + 1 FROM walk w JOIN links l ON w.terminal = l.id)
  SELECT id, arg_max(terminal, steps) AS terminal, max(steps) AS steps FROM walk GROUP BY id""")
def amendment_chains(spark: SparkSession, d: str) -> DataFrame:
    return T.chain_ends(T.amendment_links(documents(spark, d)))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, content_hash = 'sha256:' || sha256(coalesce(text, '')) AS hash_ok FROM documents")
def stored_hash_check(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", (F.col("content_hash") == S.content_hash(F.coalesce("text", F.lit("")))).alias("hash_ok"))


@query(f"""SELECT doc_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lower(printf('%02x', (CAST('0x' || substr(h,17,2) AS INTEGER) & 63) | 128)) || substr(h,19,2) || '-' || substr(h,21,12) AS uid
  FROM (SELECT doc_id, sha1(unhex('{URL_SPACE}') || encode(source_url)) AS h FROM documents WHERE source_url IS NOT NULL)""")
def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("source_url is not null").select("doc_id", uuid5(URL_SPACE, F.col("source_url")).alias("uid"))


@query("""SELECT source_span_id, CASE WHEN content IS NULL OR start_char < 0 OR end_char <= start_char OR end_char - start_char > length(content) THEN 'OFFSET_MISMATCH'
  WHEN 'sha256:' || sha256(substr(content, 1, end_char - start_char)) IS DISTINCT FROM text_hash THEN 'HASH_MISMATCH' ELSE 'ok' END AS code FROM (SELECT DISTINCT source_span_id, start_char, end_char, content, text_hash FROM passage_candidates)""")
def span_verify(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passage_candidates").select("source_span_id", "start_char", "end_char", "content", "text_hash").distinct()
    size = F.col("end_char") - F.col("start_char")
    code = F.when(F.col("start_char") < 0, "OFFSET_MISMATCH").otherwise(S.span_code(F.col("content"), F.lit(0), size, F.col("text_hash")))
    return p.select("source_span_id", F.coalesce(code, F.lit("ok")).alias("code"))


@query("""SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    lines = documents(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return S.running_offsets(lines, "doc_id", "line_no", F.col("line")).select("doc_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "start_char")


SECTIONS_SQL = f"s AS (SELECT DISTINCT {key('id')} AS id, {key('document_version_id')} AS v, start_char, end_char FROM sections)"


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select(uuid_key(F.col("id")).alias("id"), uuid_key(F.col("document_version_id")).alias("document_version_id"), "start_char", "end_char").distinct()


def spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_spans").select(uuid_key(F.col("id")).alias("id"), uuid_key(F.col("section_id")).alias("section_id"), uuid_key(F.col("document_version_id")).alias("document_version_id"), "start_char", "end_char").distinct()


SPANS_SQL = f"p AS (SELECT DISTINCT {key('id')} AS id, {key('section_id')} AS section_id, {key('document_version_id')} AS v, start_char, end_char FROM source_spans)"


@query(f"""WITH {SECTIONS_SQL}, {SPANS_SQL} SELECT p.id AS span_id, p.section_id, CASE WHEN s.v IS NULL THEN 'unknown_section' WHEN s.v <> p.v THEN 'cross_version'
  WHEN p.start_char < s.start_char OR p.end_char > s.end_char THEN 'outside_section' ELSE 'ok' END AS code FROM p LEFT JOIN s ON p.section_id = s.id""")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    return S.contained_spans(spans(spark, d), sections(spark, d))


@query(f"""WITH {SPANS_SQL}, q AS (SELECT DISTINCT v, id, start_char, end_char FROM p WHERE end_char > start_char AND v IS NOT NULL), b AS (SELECT v, start_char AS a FROM q UNION SELECT v, end_char FROM q),
  c AS (SELECT v, a AS seg_start, lead(a) OVER (PARTITION BY v ORDER BY a) AS seg_end FROM b)
  SELECT c.v AS document_version_id, seg_start, seg_end, count(*) AS covers FROM c JOIN q ON c.v = q.v AND q.start_char <= seg_start AND q.end_char >= seg_end WHERE seg_end IS NOT NULL GROUP BY ALL""")
def span_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(spans(spark, d).where("document_version_id is not null"), "document_version_id")


@query(f"""WITH {SPANS_SQL}, q AS (SELECT DISTINCT v, id, start_char, end_char FROM p WHERE v IS NOT NULL)
  SELECT o.v AS document_version_id, o.start_char AS at, arg_min(q.id, (q.end_char - q.start_char, q.id)) AS id FROM (SELECT DISTINCT v, start_char FROM q) o JOIN q ON o.v = q.v AND q.start_char <= o.start_char AND o.start_char < q.end_char GROUP BY ALL""")
def narrowest_span(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).where("document_version_id is not null")
    return S.narrowest_spans(s, s.select("document_version_id", F.col("start_char").alias("at")), "document_version_id")


@query(f"""WITH {SPANS_SQL}, q AS (SELECT DISTINCT v, id, start_char, end_char FROM p WHERE end_char > start_char AND v IS NOT NULL), b AS (SELECT v, start_char AS a FROM q UNION SELECT v, end_char FROM q)
  SELECT b.v AS document_version_id, a AS at, arg_min(q.id, (q.end_char - q.start_char, q.id)) AS id FROM b JOIN q ON b.v = q.v AND q.start_char <= a AND a < q.end_char GROUP BY ALL""")
def segment_narrowest_span(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest span of every covered segment, also of those that begin where a span ends; at is the segment's start."""
    s = spans(spark, d).where("document_version_id is not null")
    return S.narrowest_spans(s, S.segments(s, "document_version_id").select("document_version_id", F.col("seg_start").alias("at")), "document_version_id")


@query(f"""WITH {SECTIONS_SQL}, {SPANS_SQL}, w AS (SELECT id AS section_id, start_char, end_char FROM s WHERE start_char >= 0 AND end_char > start_char),
  q AS (SELECT DISTINCT w.section_id, p.id, p.start_char, p.end_char FROM p JOIN w ON p.section_id = w.section_id WHERE p.start_char >= w.start_char AND p.end_char > p.start_char AND p.end_char <= w.end_char),
  b AS (SELECT section_id, start_char AS a FROM w UNION SELECT section_id, end_char FROM w UNION SELECT section_id, start_char FROM q UNION SELECT section_id, end_char FROM q),
  c AS (SELECT section_id, a AS seg_start, lead(a) OVER (PARTITION BY section_id ORDER BY a) AS seg_end FROM b)
  SELECT c.section_id, seg_start, seg_end, q.id AS span_id FROM c LEFT JOIN q ON c.section_id = q.section_id AND q.start_char <= seg_start AND q.end_char >= seg_end WHERE seg_end IS NOT NULL""")
def section_segment_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sections cut at the boundaries of their spans: a row for each span over a segment, one with a null span_id where none is."""
    return S.section_segments(spans(spark, d), sections(spark, d))


@query(f"""WITH {SECTIONS_SQL} SELECT v AS document_version_id, id, start_char, coalesce(lead(start_char) OVER (PARTITION BY v ORDER BY start_char, id), m) AS end_char
  FROM (SELECT *, max(end_char) OVER (PARTITION BY v) AS m FROM s) WHERE v IS NOT NULL""")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d).where("document_version_id is not null")
    return S.flat_sections(s, s.groupBy("document_version_id").agg(F.max("end_char").alias("n_chars")))


@query(f"""SELECT check_name, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT (start_char >= 0) THEN 'start_not_negative' END, CASE WHEN NOT (end_char > start_char) THEN 'end_after_start' END, CASE WHEN NOT (end_char - start_char <= 400) THEN 'short_enough' END,
  CASE WHEN NOT regexp_full_match(text_hash, 'sha256:[0-9a-f]{{64}}') THEN 'hash_form' END], lambda x: x IS NOT NULL)) AS check_name FROM (SELECT DISTINCT id, start_char, end_char, text_hash FROM source_spans)) GROUP BY 1""")
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_spans").select("id", "start_char", "end_char", "text_hash").distinct()
    found = Q.violations(s, "id", {"start_not_negative": F.col("start_char") >= 0, "end_after_start": F.col("end_char") > F.col("start_char"), "short_enough": F.col("end_char") - F.col("start_char") <= 400, "hash_form": F.col("text_hash").rlike("^sha256:[0-9a-f]{64}$")})
    return found.groupBy(F.col("check").alias("check_name")).agg(F.count("*").alias("n"))


@query("SELECT fact_key, count(*) AS n FROM (SELECT DISTINCT id, fact_key FROM financial_facts WHERE duplicate_of IS NULL AND fact_key IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def canonical_not_unique(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts").where("fact_key is not null and duplicate_of is null").select("id", "fact_key").distinct()
    return Q.not_unique(f, ["fact_key"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def unanchored_lines(spark: SparkSession, d: str) -> DataFrame:
    return Q.orphans(table(spark, d, "lineitem"), ["l_orderkey"], table(spark, d, "orders").where("o_orderstatus <> 'P'"), ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query(f"""WITH {SECTIONS_SQL}, {SPANS_SQL} SELECT p.id FROM p WHERE section_id IS NOT NULL AND v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = p.section_id AND s.v = p.v AND s.start_char > 0)""")
def composite_orphans(spark: SparkSession, d: str) -> DataFrame:
    return Q.orphans(spans(spark, d), ["section_id", "document_version_id"], sections(spark, d).where("start_char > 0"), ["id", "document_version_id"]).select("id")


@query("SELECT id, (kind = 'fact' AND financial_fact_id IS NOT NULL AND table_row_index IS NULL) OR (kind = 'table_row' AND table_row_index IS NOT NULL AND financial_fact_id IS NULL) AS anchored FROM (SELECT DISTINCT id, kind, financial_fact_id, table_row_index FROM lane_candidates) WHERE kind IN ('fact', 'table_row')")
def kind_anchor(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lane_candidates").where("kind in ('fact', 'table_row')").select("id", "kind", "financial_fact_id", "table_row_index").distinct()
    return c.select("id", Q.one_kind_anchor(F.col("kind"), {"fact": F.col("financial_fact_id"), "table_row": F.col("table_row_index")}).alias("anchored"))


COUNTS_SQL = "count(*) AS n_total, count(*) FILTER (duplicate_of IS NULL) AS n_canonical, count(*) FILTER (duplicate_of IS NOT NULL) AS n_duplicate, count(*) FILTER (restates IS NOT NULL) AS n_restated"


@query(f"SELECT concept, {COUNTS_SQL} FROM (SELECT DISTINCT id, concept, duplicate_of, restates FROM financial_facts) GROUP BY 1")
def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.fact_counts(table(spark, d, "financial_facts").select("id", "concept", "duplicate_of", "restates").distinct(), ["concept"])


@query("SELECT entity_id, form, count(*) AS n_documents, count(DISTINCT accession) AS n_accessions FROM documents GROUP BY ROLLUP (entity_id, form)")
def qa_rollup(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).rollup("entity_id", "form").agg(F.count("*").alias("n_documents"), F.countDistinct("accession").alias("n_accessions"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def qa_cube(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def qa_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_sets")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem_sets GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query("SELECT form, CASE WHEN count(*) = 0 THEN 'unavailable' ELSE printf('%.6f', count(*) FILTER (text IS NOT NULL) / count(*)) END AS rate FROM documents GROUP BY 1")
def text_rate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("form").agg(Q.rate_text(F.count("text"), F.count("*")).alias("rate"))


@query("""(SELECT k, 'missing' AS side FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) UNION ALL (SELECT k, 'surplus' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def reconcile_customers(spark: SparkSession, d: str) -> DataFrame:
    return Q.reconcile(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT user_id, round(coalesce(sum(value) FILTER (date_trunc('day', ts) = TIMESTAMP '2024-01-20'), 0), 4) AS day_spend, round(coalesce(sum(value) FILTER (date_trunc('month', ts) = TIMESTAMP '2024-01-01'), 0), 4) AS month_spend FROM events GROUP BY 1""")
def spend_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return Q.spend(table(spark, d, "events"), F.lit("2024-01-20 10:00:00").cast("timestamp"), "user_id", "value", "ts")


@query("""SELECT user_id, CASE WHEN day_spend >= 400 OR month_spend >= 6000 THEN 'block' WHEN day_spend >= 200 OR month_spend >= 3000 THEN 'warn' ELSE 'ok' END AS verdict FROM (
  SELECT user_id, round(coalesce(sum(value) FILTER (date_trunc('day', ts) = TIMESTAMP '2024-01-20'), 0), 4) AS day_spend, round(coalesce(sum(value) FILTER (date_trunc('month', ts) = TIMESTAMP '2024-01-01'), 0), 4) AS month_spend FROM events GROUP BY 1)""")
def spend_ceiling(spark: SparkSession, d: str) -> DataFrame:
    s = spend_snapshot(spark, d)
    return s.select("user_id", Q.ceiling(F.col("day_spend"), F.col("month_spend"), 200, 400, 3000, 6000).alias("verdict"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def p95_value(spark: SparkSession, d: str) -> DataFrame:
    return Q.exact_quantile(table(spark, d, "events"), ["event_type"], "value", 0.95, "p95")


@query("SELECT accession FROM documents WHERE form = '10-K' INTERSECT SELECT accession FROM documents WHERE valid_to IS NOT NULL")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return docs.where("form = '10-K'").select("accession").intersect(docs.where("valid_to is not null").select("accession"))


@query("SELECT accession FROM documents WHERE form = '10-K' EXCEPT SELECT accession FROM documents WHERE valid_to IS NOT NULL")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return docs.where("form = '10-K'").select("accession").subtract(docs.where("valid_to is not null").select("accession"))


@query("SELECT id, len(list_intersect(coalesce(documents_reviewed, []), coalesce(future_revisions, []))) > 0 AS overlaps FROM (SELECT DISTINCT id, documents_reviewed, future_revisions FROM manifest_entries)")
def revisions_disjoint(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest_entries").select("id", "documents_reviewed", "future_revisions").distinct()
    none = F.array().cast("array<string>")
    return m.select("id", F.arrays_overlap(F.coalesce("documents_reviewed", none), F.coalesce("future_revisions", none)).alias("overlaps"))
