"""Queries over evidence: pins, traces, anchors, lanes of a run, manifests, search by words and by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import texts as X
from lodestrata.functions.ids import accession_key, uuid_key
from lodestrata.operators import benchmark as B
from lodestrata.operators import claims as C
from lodestrata.operators import fulltext, vectors
from lodestrata.operators import ingest as I
from lodestrata.operators import payloads as P
from lodestrata.operators import quality as Q
from lodestrata.operators import retrieval as R
from lodestrata.operators import spans as S
from lodestrata.operators import temporal as T
from lodestrata.plans.corpus import SECTIONS_SQL, SPANS_SQL, VERSIONS_SQL, documents, sections, spans, versions
from lodestrata.plans.problems_sql import key
from lodestrata.plans.registry import Registry
from lodestrata.plans.search import neighbours
from lodestrata.plans.tables import table

query = Registry()


def digits(c: str) -> str:
    return f"nullif(regexp_replace({c}, '[^0-9]', '', 'g'), '')"


def lanes(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    return table(spark, d, "lane_candidates").select(*columns).distinct()


def listed(order: list[str], value: str, between: str) -> Column:
    """Values of a small group in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return F.array_join(F.transform(rows, lambda x: x["__value"].cast("string")), between)


@query(f"WITH s AS (SELECT DISTINCT {key('id')} AS id, {key('document_version_id')} AS v, heading FROM sections), {SPANS_SQL} SELECT DISTINCT p.id AS span_id, s.id AS section_id, s.heading FROM p JOIN s ON p.section_id = s.id AND p.v = s.v")
def span_headings(spark: SparkSession, d: str) -> DataFrame:
    """Spans with the heading of their section, matched by section and version together."""
    s = table(spark, d, "sections").select(uuid_key(F.col("id")).alias("section_id"), uuid_key(F.col("document_version_id")).alias("document_version_id"), "heading").distinct()
    return spans(spark, d).select(F.col("id").alias("span_id"), "section_id", "document_version_id").join(s, ["section_id", "document_version_id"]).select("span_id", "section_id", "heading").distinct()


@query(f"""WITH {VERSIONS_SQL} SELECT doc_id, count(v.id) AS n, CASE WHEN count(v.id) = 1 THEN min(v.id) END AS version_id, CASE WHEN count(v.id) = 0 THEN 'NO_VERSION' WHEN count(v.id) > 1 THEN 'MANY_VERSIONS' END AS code
  FROM documents d LEFT JOIN v ON v.document_id = {key('d.id')} AND v.status = 'parsed' GROUP BY doc_id""")
def pinned_versions(spark: SparkSession, d: str) -> DataFrame:
    """The one parsed version of each document; none and several are errors."""
    return T.pinned(documents(spark, d).select("doc_id", uuid_key(F.col("id")).alias("document_id")), versions(spark, d).where("status = 'parsed'"), "doc_id")


@query(f"SELECT DISTINCT c.id, c.run_id, c.lane, c.lane_rank, d.doc_id, d.form FROM lane_candidates c JOIN documents d ON {key('c.document_id')} = {key('d.id')}")
def trace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a run with the documents they come from."""
    c = table(spark, d, "lane_candidates").select("id", "run_id", "lane", "lane_rank", uuid_key(F.col("document_id")).alias("__d")).distinct()
    return c.join(documents(spark, d).select(uuid_key(F.col("id")).alias("__d"), "doc_id", "form"), "__d").drop("__d")


@query("SELECT run_id, lane, string_agg(item_id, ',' ORDER BY lane_rank, item_id) AS items FROM (SELECT DISTINCT run_id, lane, item_id, lane_rank FROM lane_candidates) GROUP BY ALL")
def lane_columns(spark: SparkSession, d: str) -> DataFrame:
    """The items of each lane of a run, in the order of their ranks."""
    c = lanes(spark, d, "run_id", "lane", "item_id", "lane_rank")
    return c.groupBy("run_id", "lane").agg(listed(["lane_rank", "item_id"], "item_id", ",").alias("items"))


@query("SELECT run_id, string_agg('[' || lane_rank || '] ' || lane || ' ' || item_id, chr(10) ORDER BY lane_rank, lane, item_id) AS context FROM (SELECT DISTINCT run_id, lane, item_id, lane_rank FROM lane_candidates WHERE lane_rank <= 16) GROUP BY 1")
def context_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a run may quote, a line per candidate within the context budget."""
    c = lanes(spark, d, "run_id", "lane", "item_id", "lane_rank").where("lane_rank <= 16")
    c = c.withColumn("line", F.concat(F.lit("["), F.col("lane_rank").cast("string"), F.lit("] "), "lane", F.lit(" "), "item_id"))
    return c.groupBy("run_id").agg(listed(["lane_rank", "lane", "item_id"], "line", "\n").alias("context"))


@query(f"""WITH {SPANS_SQL}, f AS (SELECT DISTINCT id, {key('source_span_id')} AS s, {key('document_version_id')} AS v FROM financial_facts)
  SELECT f.id, CASE WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.id = f.s) THEN 'UNKNOWN_SPAN' WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.id = f.s AND p.v = f.v) THEN 'WRONG_VERSION' ELSE 'ok' END AS code FROM f WHERE f.s IS NOT NULL""")
def evidence_pins(spark: SparkSession, d: str) -> DataFrame:
    """Facts against the spans they cite: unknown, of another version, or right."""
    f = table(spark, d, "financial_facts").select("id", uuid_key(F.col("source_span_id")).alias("span"), uuid_key(F.col("document_version_id")).alias("version")).distinct()
    return Q.pin_codes(f.where("span is not null"), spans(spark, d).select(F.col("id").alias("span"), F.col("document_version_id").alias("version")), "span", "version").select("id", "code")


@query(f"""WITH {VERSIONS_SQL}, k AS (SELECT DISTINCT id, entity_id, period_end, {key('document_version_id')} AS v FROM kpi_payloads)
  SELECT DISTINCT k.id, doc_id, array_to_string(list_filter([CASE WHEN k.entity_id IS DISTINCT FROM d.entity_id THEN 'entity_id' END, CASE WHEN k.period_end IS DISTINCT FROM d.period_end THEN 'period_end' END], lambda x: x IS NOT NULL), ',') AS differing
  FROM k JOIN v ON k.v = v.id JOIN documents d ON v.document_id = {key('d.id')}""")
def pin_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Payloads against the document they were read from, field by field."""
    k = table(spark, d, "kpi_payloads").select("id", "entity_id", "period_end", uuid_key(F.col("document_version_id")).alias("v")).distinct()
    docs = documents(spark, d).select(uuid_key(F.col("id")).alias("document_id"), "doc_id", F.col("entity_id").alias("__entity"), F.col("period_end").alias("__end"))
    joined = k.join(versions(spark, d).select(F.col("id").alias("v"), "document_id"), "v").join(docs, "document_id")
    return joined.select("id", "doc_id", F.array_join(Q.differing({"entity_id": ("entity_id", "__entity"), "period_end": ("period_end", "__end")}), ",").alias("differing")).distinct()


@query(f"WITH {VERSIONS_SQL} SELECT DISTINCT v.id AS version_id, d.doc_id FROM v JOIN documents d ON v.document_id = {key('d.id')}")
def version_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document behind each version, for links into it."""
    docs = documents(spark, d).select(uuid_key(F.col("id")).alias("document_id"), "doc_id")
    return versions(spark, d).select(F.col("id").alias("version_id"), "document_id").join(docs, "document_id").select("version_id", "doc_id").distinct()


@query("SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS parent_id FROM events")
def rerun_parent(spark: SparkSession, d: str) -> DataFrame:
    """The earliest event of the same user and kind, of which the others are reruns."""
    e = table(spark, d, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("parent_id"))
    return e.select("event_id", "user_id", "event_type").join(first, ["user_id", "event_type"]).select("event_id", "parent_id")


@query(f"SELECT parser_version, normalizer_version, count(DISTINCT {key('id')}) AS n_versions, count(DISTINCT {key('document_id')}) AS n_documents FROM document_versions GROUP BY ALL")
def version_pin_counts(spark: SparkSession, d: str) -> DataFrame:
    """Versions and documents under each pair of pinned parsers."""
    v = table(spark, d, "document_versions")
    return v.groupBy("parser_version", "normalizer_version").agg(F.countDistinct(uuid_key(F.col("id"))).alias("n_versions"), F.countDistinct(uuid_key(F.col("document_id"))).alias("n_documents"))


@query(f"SELECT form, count(DISTINCT {digits('accession')}) AS n FROM documents WHERE text IS NULL OR text = '' GROUP BY 1")
def quarantined_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Filings without a text, per form."""
    return documents(spark, d).where("text is null or text = ''").groupBy("form").agg(F.countDistinct(accession_key(F.col("accession"))).alias("n"))


@query("SELECT category, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS n_tokens, count(*) AS n_items FROM eval_items GROUP BY 1")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    return e.groupBy("category").agg(F.sum(X.approx_tokens(F.col("text")).cast("bigint")).alias("n_tokens"), F.count("*").alias("n_items"))


@query("SELECT parser_version, count(*) AS n_total, count(*) FILTER (status = 'parsed') AS n_succeeded, count(*) FILTER (status IS NULL OR status NOT IN ('parsed', 'failed', 'quarantined')) AS n_pending, count(*) FILTER (status IN ('failed', 'quarantined')) AS n_failed FROM (SELECT DISTINCT id, parser_version, status FROM document_versions) GROUP BY 1")
def job_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parse jobs: done, failed and still open."""
    v = table(spark, d, "document_versions").select("id", "parser_version", "status").distinct()
    return Q.job_counts(v, ["parser_version"], "status", ["parsed"], ["failed", "quarantined"])


@query("SELECT entity_id, count(*) AS n_documents, count(*) FILTER (text IS NULL) AS n_empty, count(*) FILTER (published_at IS NULL) AS n_undated FROM documents GROUP BY GROUPING SETS ((entity_id), ())")
def issuer_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts per issuer and over all of them."""
    return documents(spark, d).rollup("entity_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("text").isNull()).alias("n_empty"), F.count_if(F.col("published_at").isNull()).alias("n_undated"))


@query("SELECT event_type, max(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS most, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS malformed FROM events GROUP BY 1")
def max_json_number(spark: SparkSession, d: str) -> DataFrame:
    """The greatest number in a JSON field; rows in which it is none are counted apart."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.max(k).alias("most"), F.count_if(k.isNull()).alias("malformed"))


@query("SELECT run_id, count(DISTINCT item_id) FILTER (lane = 'dense') AS n_dense, count(DISTINCT item_id) FILTER (lane = 'lexical') AS n_lexical, sum(lane_rank) FILTER (lane = 'dense') IS DISTINCT FROM sum(lane_rank) FILTER (lane = 'lexical') AS changed FROM (SELECT DISTINCT run_id, item_id, lane, lane_rank FROM lane_candidates) GROUP BY 1")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two lanes of a run side by side, and whether they differ."""
    c = lanes(spark, d, "run_id", "item_id", "lane", "lane_rank")
    of = lambda lane, c: F.when(F.col("lane") == lane, F.col(c))
    return c.groupBy("run_id").agg(F.countDistinct(of("dense", "item_id")).alias("n_dense"), F.countDistinct(of("lexical", "item_id")).alias("n_lexical"), (~F.sum(of("dense", "lane_rank")).eqNullSafe(F.sum(of("lexical", "lane_rank")))).alias("changed"))


@query(f"SELECT DISTINCT {digits('a')} AS accession FROM (SELECT unnest(documents_reviewed) AS a FROM manifest_entries UNION SELECT unnest(future_revisions) FROM manifest_entries) WHERE {digits('a')} IS NOT NULL")
def cited_accessions(spark: SparkSession, d: str) -> DataFrame:
    """All accessions that any entry names, whatever for."""
    m = table(spark, d, "manifest_entries")
    a = m.select(F.explode("documents_reviewed").alias("a")).unionByName(m.select(F.explode("future_revisions").alias("a")))
    return a.select(accession_key(F.col("a")).alias("accession")).where("accession is not null").distinct()


@query("""SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS accessions FROM (SELECT id, list_filter(list_concat(coalesce(documents_reviewed, []), coalesce(future_revisions, [])), lambda x: x IS NOT NULL) AS l
  FROM (SELECT DISTINCT id, documents_reviewed, future_revisions FROM manifest_entries))""")
def first_seen_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Both lists of an entry one behind the other, each accession where it comes first."""
    m = table(spark, d, "manifest_entries").select("id", "documents_reviewed", "future_revisions").distinct()
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("documents_reviewed", none), F.coalesce("future_revisions", none))
    return m.select("id", F.array_join(F.array_distinct(F.array_compact(both)), ",").alias("accessions"))


@query("SELECT doc_id, entity_id FROM documents WHERE entity_id IS NULL OR entity_id = (SELECT entity_id FROM documents WHERE entity_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1)")
def tenant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows a tenant may see: its own and those of nobody. The tenant is the entity with most documents."""
    docs = documents(spark, d).select("doc_id", "entity_id")
    claim = docs.where("entity_id is not null").groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").limit(1).select(F.col("entity_id").alias("claim"))
    return Q.visible_to(docs, claim, "entity_id")


@query("SELECT id, len(documents_reviewed) AS n, len(documents_reviewed) BETWEEN 1 AND 3 AS within FROM (SELECT DISTINCT id, documents_reviewed FROM manifest_entries)")
def list_bounds(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest_entries").select("id", "documents_reviewed").distinct()
    n = F.when(F.col("documents_reviewed").isNotNull(), F.size("documents_reviewed")).cast("bigint")
    return m.select("id", n.alias("n"), n.between(1, 3).alias("within"))


@query(f"""WITH m AS (SELECT DISTINCT id, documents_reviewed AS r, future_revisions AS f FROM manifest_entries), x AS (SELECT id, {digits('a')} AS acc FROM (SELECT id, unnest(r) AS a FROM m)), y AS (SELECT id, {digits('a')} AS acc FROM (SELECT id, unnest(f) AS a FROM m)),
  d AS (SELECT DISTINCT {digits('accession')} AS acc FROM documents), c AS (SELECT id, 'NO_EVIDENCE' AS code FROM m WHERE id NOT IN (SELECT id FROM x WHERE acc IS NOT NULL) UNION SELECT id, 'UNKNOWN_ACCESSION' FROM x WHERE acc IS NOT NULL AND acc NOT IN (SELECT acc FROM d WHERE acc IS NOT NULL)
  UNION SELECT id, 'DUPLICATE_EVIDENCE' FROM x WHERE acc IS NOT NULL GROUP BY id, acc HAVING count(*) > 1 UNION SELECT x.id, 'EVIDENCE_IS_REVISION' FROM x JOIN y ON x.id = y.id AND x.acc = y.acc)
  SELECT m.id, coalesce(string_agg(c.code, ',' ORDER BY c.code), '') AS codes FROM (SELECT DISTINCT id FROM m) m LEFT JOIN c ON m.id = c.id GROUP BY 1""")
def manifest_codes(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each entry of a benchmark manifest."""
    m = table(spark, d, "manifest_entries").select("id", "documents_reviewed", "future_revisions").distinct()
    known = documents(spark, d).select(accession_key(F.col("accession")).alias("acc")).where("acc is not null").distinct()
    return B.manifest_codes(m, known)


@query("""WITH a AS (SELECT DISTINCT run_id, item_id, source_span_id FROM lane_candidates WHERE lane = 'dense'), c AS (SELECT DISTINCT run_id, item_id, source_span_id FROM lane_candidates WHERE lane = 'lexical')
  SELECT c.run_id, count(*) AS n_citations, count(*) FILTER (a.run_id IS NULL) AS n_unknown, count(*) FILTER (a.run_id IS NULL) > 0 AS downgraded FROM c LEFT JOIN a ON a.run_id = c.run_id AND a.item_id = c.item_id AND a.source_span_id = c.source_span_id GROUP BY 1""")
def claim_downgrades(spark: SparkSession, d: str) -> DataFrame:
    """Runs that cite a pair of item and span which isn't among the accepted ones."""
    c = lanes(spark, d, "run_id", "item_id", "source_span_id", "lane")
    accepted = c.where("lane = 'dense'").drop("lane").withColumn("known", F.lit(True))
    joined = c.where("lane = 'lexical'").drop("lane").join(accepted, ["run_id", "item_id", "source_span_id"], "left")
    return joined.groupBy("run_id").agg(F.count("*").alias("n_citations"), F.count_if(F.col("known").isNull()).alias("n_unknown")).withColumn("downgraded", F.col("n_unknown") > 0)


@query("SELECT DISTINCT id, CASE WHEN financial_fact_id IS NOT NULL THEN 'fact:' || financial_fact_id WHEN table_row_index IS NOT NULL THEN 'row:' || coalesce(source_span_id, '') || '#' || table_row_index ELSE 'span:' || coalesce(source_span_id, '') END AS anchor FROM lane_candidates")
def source_anchors(spark: SparkSession, d: str) -> DataFrame:
    c = lanes(spark, d, "id", "financial_fact_id", "table_row_index", "source_span_id")
    return c.select("id", R.anchor_text(F.col("financial_fact_id"), F.col("source_span_id"), F.col("table_row_index")).alias("anchor")).distinct()


@query(f"""WITH {SECTIONS_SQL}, {SPANS_SQL} SELECT DISTINCT p.id AS span_id, s.id AS section_id, CASE WHEN p.start_char >= s.start_char AND p.end_char <= s.end_char AND p.end_char > p.start_char THEN p.start_char - s.start_char END AS local_start,
  CASE WHEN p.start_char >= s.start_char AND p.end_char <= s.end_char AND p.end_char > p.start_char THEN p.end_char - s.start_char END AS local_end FROM p JOIN s ON p.section_id = s.id""")
def local_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Spans in offsets of their section."""
    s = sections(spark, d).select(F.col("id").alias("section_id"), F.col("start_char").alias("__s"), F.col("end_char").alias("__e"))
    p = spans(spark, d).select(F.col("id").alias("span_id"), "section_id", "start_char", "end_char").join(s, "section_id")
    a = S.local_anchor(F.col("start_char"), F.col("end_char"), F.col("__s"), F.col("__e"))
    return p.select("span_id", "section_id", a.alias("a")).select("span_id", "section_id", F.col("a.start").alias("local_start"), F.col("a.end").alias("local_end")).distinct()


@query("""SELECT t.id AS target, count(d.id) AS n_siblings, arg_max(d.id, (d.published_at, d.id)) AS latest, strftime(max(d.published_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS latest_at FROM documents t LEFT JOIN documents d ON t.entity_id = d.entity_id AND d.id <> t.id AND d.published_at <= t.published_at
  WHERE t.entity_id IS NOT NULL AND t.published_at IS NOT NULL GROUP BY 1""")
def sibling_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the number of documents of its entity known by then, and the latest of them."""
    return T.sibling_summary(documents(spark, d).select("id", "entity_id", "published_at")).withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss"))


SEARCHES = ('revenue "credit agreement"', "impairment OR write-downs -quarter", '"board approved" positions', "customers inventory OR backlog")


def _search_sql() -> str:
    parts = [f"SELECT {i} AS search, item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM ({fulltext.search_sql('documents', 'doc_id', 'text', q)})" for i, q in enumerate(SEARCHES)]
    return " UNION ALL ".join(f"SELECT * FROM ({p}) WHERE rank <= 100" for p in parts)


@query(_search_sql())
def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred documents of searches with phrases, alternatives and exclusions, by stems."""
    out = None
    for i, q in enumerate(SEARCHES):
        top = fulltext.search(documents(spark, d), "doc_id", "text", q).orderBy(F.col("score").desc(), "item_id").limit(100)
        top = R.ranked(top, [], [F.col("score").desc(), F.col("item_id")]).select(F.lit(i).alias("search"), "item_id", "score", "rank")
        out = top if out is None else out.unionByName(top)
    return out


#: Cells of the index over the embeddings.
CELLS = 32


def index_neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    centres, probes = vectors.fit_index(e, "vec_id", "embedding", CELLS, k)
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.index_knn(vectors.indexed(e, "vec_id", "embedding", centres), asked, "vec_id", "embedding", k, centres, probes)


@query()
def index_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors through the index, for every vector whose id is divisible by 50."""
    return index_neighbours(spark, d, 10)


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Is the recall at 10 of the index against the exact lane 0.9 or more?"""
    found, gold = index_neighbours(spark, d, 10).select("query_id", "item_id"), neighbours(spark, d, 10).select("query_id", "item_id")
    hit = gold.join(found.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") / F.count("*") >= 0.9).alias("reached"))


@query("WITH l AS (SELECT DISTINCT concept, lower(trim(split_part(label, ' ', 1))) AS word FROM financial_facts WHERE label IS NOT NULL) SELECT DISTINCT d.concept AS metric_id, a.concept AS other FROM l d JOIN l a ON d.word = a.word AND d.concept <> a.concept")
def alias_hits(spark: SparkSession, d: str) -> DataFrame:
    """Concepts one of whose labels begins like a label of another concept."""
    f = table(spark, d, "financial_facts").select("concept", F.split_part("label", F.lit(" "), F.lit(1)).alias("label")).distinct()
    return P.alias_hits(f.select(F.col("concept").alias("metric_id"), F.col("label").alias("definition")), f.select(F.col("concept").alias("metric_id"), F.col("label").alias("alias")))


@query("SELECT claim_id, round(share, 6) AS share FROM (SELECT q.id AS claim_id, max(len(list_intersect(s, c)) / len(s)) AS share FROM (SELECT id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS s, category FROM (SELECT DISTINCT id, category, question FROM manifest_entries)) q JOIN (SELECT category, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS c FROM eval_items) x ON x.category = q.category WHERE len(s) > 0 GROUP BY 1) WHERE share >= 0.2")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """The best share of a question's words that one item of its category has, from a fifth on."""
    claims = table(spark, d, "manifest_entries").select(F.col("id").alias("claim_id"), "category", "question").distinct()
    claims = claims.select("claim_id", "category", F.array_sort(C.token_set(F.col("question"))).alias("words"))
    items = table(spark, d, "eval_items").select("category", C.token_set(F.col("text")).alias("words"))
    return C.word_support(claims, items, "category", 0.2).select("claim_id", F.round("share", 6).alias("share"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) AS n FROM events) WHERE n = 1")
def next_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The job of each queue that comes next: the highest priority, then the oldest. One aggregation, so a queue of any length stays small."""
    e = table(spark, d, "events").select("event_type", F.struct((-F.col("value")).alias("p"), "ts", "event_id", "value").alias("job"))
    return e.groupBy("event_type").agg(F.min("job").alias("job")).select("event_type", "job.event_id", "job.value")


@query("SELECT event_id, CASE WHEN n = 1 THEN 'accepted' WHEN value IS NOT DISTINCT FROM first THEN 'replay' ELSE 'conflict' END AS outcome FROM (SELECT event_id, value, row_number() OVER w AS n, first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id))")
def idempotent_writes(spark: SparkSession, d: str) -> DataFrame:
    """The first write under a key counts; later ones are replays if they say the same, else conflicts."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value")
    return Q.first_writes(e, ["user_id", "event_type", "k"], "event_id", "value")


@query("SELECT user_id, max(value) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def monotone_counters(spark: SparkSession, d: str) -> DataFrame:
    return P.merged_counters(table(spark, d, "events"), "user_id", ["value", "event_id"])


@query("SELECT sha256(run_id || ':' || item_id || ':' || lane) AS feedback_key, id FROM (SELECT DISTINCT id, run_id, item_id, lane FROM lane_candidates)")
def feedback_keys(spark: SparkSession, d: str) -> DataFrame:
    return lanes(spark, d, "id", "run_id", "item_id", "lane").select(F.sha2(F.concat_ws(":", "run_id", "item_id", "lane"), 256).alias("feedback_key"), "id")


@query("WITH t AS (SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS s FROM orders GROUP BY 1) SELECT sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, sum(n) = (SELECT count(*) FROM orders) AND sum(s) = (SELECT sum(o_custkey) FROM orders) AS consistent FROM t")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Do the parts of a report add up to its totals?"""
    r = table(spark, d, "orders").rollup("o_orderstatus").agg(F.grouping("o_orderstatus").alias("whole"), F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
    part = lambda c, w: F.sum(F.when(F.col("whole") == w, F.col(c)))
    return r.agg(part("n", 0).alias("n"), part("s", 0).alias("s"), ((part("n", 0) == part("n", 1)) & (part("s", 0) == part("s", 1))).alias("consistent"))


@query("SELECT run_id, CAST(to_json({'run_id': run_id, 'rows': list({'lane': lane, 'rank': lane_rank, 'item': item_id} ORDER BY lane, lane_rank, item_id)}) AS VARCHAR) AS trace FROM (SELECT DISTINCT run_id, lane, lane_rank, item_id FROM lane_candidates) GROUP BY 1")
def trace_json(spark: SparkSession, d: str) -> DataFrame:
    """The trace of a run as one JSON text that is the same whenever it is made."""
    c = lanes(spark, d, "run_id", "lane", F.col("lane_rank").alias("rank"), F.col("item_id").alias("item"))
    rows = F.array_sort(F.collect_list(F.struct("lane", "rank", "item")))
    return c.groupBy("run_id").agg(rows.alias("rows")).select("run_id", F.to_json(F.struct("run_id", "rows")).alias("trace"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS spent, CASE WHEN round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) > 1000 THEN 'blocked' ELSE 'allowed' END AS verdict FROM events")
def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Charges in their order, each with what was spent by then and whether it is still allowed."""
    return Q.budget(table(spark, d, "events"), "user_id", "event_id", "value", 1000).select("event_id", "spent", "verdict")


@query("SELECT user_id, event_type, max(event_id) AS current_id, count(*) - 1 AS n_superseded FROM events GROUP BY ALL")
def current_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback is only ever added: the last entry of a key counts and supersedes the others."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("current_id"), (F.count("*") - 1).alias("n_superseded"))


@query("""WITH f AS (SELECT DISTINCT id, entity_id, fact_key, value, ingested_at FROM financial_facts WHERE fact_key IS NOT NULL AND entity_id IS NOT NULL), l AS (SELECT id, value, lag(id) OVER w AS prior, lag(value) OVER w AS before FROM f WINDOW w AS (PARTITION BY entity_id, fact_key ORDER BY ingested_at, id))
  SELECT id, CASE WHEN prior IS NULL THEN 'new' WHEN before IS NOT DISTINCT FROM value THEN 'repeats' ELSE 'restates' END AS link, prior FROM l""")
def ingest_links(spark: SparkSession, d: str) -> DataFrame:
    """Facts in the order they came in, each linked to the one it repeats or restates."""
    f = table(spark, d, "financial_facts").where("fact_key is not null and entity_id is not null").select("id", "entity_id", "fact_key", "value", "ingested_at").distinct()
    return I.value_links(f, ["entity_id", "fact_key"], ["ingested_at", "id"], "value", "id")


@query("SELECT item_id, len(s) AS n_claims, array_to_string(s, '|') AS claims FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM eval_items)")
def mock_claims(spark: SparkSession, d: str) -> DataFrame:
    """Texts taken apart into claims as they stand, a sentence each."""
    s = C.claims_of(F.col("text"))
    return table(spark, d, "eval_items").select("item_id", F.size(s).cast("bigint").alias("n_claims"), F.array_join(s, "|").alias("claims"))


@query("WITH s AS (SELECT category, count(*) AS n, count(*) FILTER (answerable) AS k FROM (SELECT DISTINCT id, category, answerable FROM manifest_entries) GROUP BY 1) SELECT category AS metric, category || ': ' || printf('%.4f', k / n) || ' of ' || n || CASE WHEN k / n >= 0.9 THEN ' passed' ELSE ' failed' END AS line FROM s")
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of the gates as lines of a report, to 4 places."""
    m = table(spark, d, "manifest_entries").select("id", "category", "answerable").distinct().groupBy(F.col("category").alias("metric")).agg(F.count_if("answerable").alias("k"), F.count("*").alias("n"))
    share = F.col("k") / F.col("n")
    return m.select("metric", F.concat("metric", F.lit(": "), F.format_string("%.4f", share), F.lit(" of "), F.col("n").cast("string"), F.when(share >= 0.9, " passed").otherwise(" failed")).alias("line"))


@query(f"SELECT DISTINCT doc_id, published_at <= TIMESTAMPTZ '2022-06-30 12:00:00+00' AND {digits('accession')} IN (SELECT {digits('a')} FROM (SELECT unnest(documents_reviewed) AS a FROM manifest_entries) WHERE {digits('a')} IS NOT NULL) AS cited FROM documents WHERE published_at IS NOT NULL AND {digits('accession')} IS NOT NULL")
def cited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents known by the cutoff that an entry cites."""
    acc = table(spark, d, "manifest_entries").select(F.explode("documents_reviewed").alias("a")).select(accession_key(F.col("a")).alias("acc")).where("acc is not null").distinct().withColumn("__in", F.lit(True))
    docs = documents(spark, d).select("doc_id", "published_at", accession_key(F.col("accession")).alias("acc")).where("published_at is not null and acc is not null")
    known = F.col("published_at") <= F.lit("2022-06-30 12:00:00").cast("timestamp")
    return docs.join(acc, "acc", "left").select("doc_id", (known & F.col("__in").isNotNull()).alias("cited")).distinct()
