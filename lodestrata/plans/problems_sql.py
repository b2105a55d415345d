"""The same questions as ``plans.problems`` in DuckDB's SQL, asked in another way."""

from __future__ import annotations


def key(c: str) -> str:
    """Comparable UUID; null for null and blank."""
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s', '', 'g'), '^urn:uuid:', ''), '[-{{}}]', '', 'g'), '')"


def spelled(c: str) -> str:
    return f"substr({c},1,8) || '-' || substr({c},9,4) || '-' || substr({c},13,4) || '-' || substr({c},17,4) || '-' || substr({c},21)"


def stamp(c: str, form: str = "%Y-%m-%d %H:%M:%S") -> str:
    return f"strftime({c} AT TIME ZONE 'UTC', '{form}')"


# Unit labels of the test tables, what they mean, and their power of ten.
LABELS = """
unit_labels(label, common_unit, power) AS (VALUES
 ('usd','USD',0), ('us$','USD',0), ('u.s. dollars','USD',0), ('iso4217:usd','USD',0),
 ('usdm','USD',6), ('usd in millions','USD',6), ('usd thousands','USD',3), ('kusd','USD',3), ('us cents','USD',-2),
 ('eur','EUR',0), ('euro','EUR',0), ('€','EUR',0), ('iso4217:eur','EUR',0), ('eur million','EUR',6), ('keur','EUR',3), ('t€','EUR',3),
 ('gbp','GBP',0), ('£','GBP',0), ('iso4217:gbp','GBP',0), ('gbpm','GBP',6), ('gbx','GBP',-2), ('pence','GBP',-2),
 ('jpy','JPY',0), ('yen','JPY',0), ('iso4217:jpy','JPY',0), ('million yen','JPY',6), ('jpy mn','JPY',6),
 ('usd/shares','USD/shares',0), ('usd/share','USD/shares',0), ('usd per share','USD/shares',0),
 ('iso4217:usd/xbrli:shares','USD/shares',0), ('cents per share','USD/shares',-2),
 ('shares','shares',0), ('share','shares',0), ('xbrli:shares','shares',0), ('thousand shares','shares',3),
 ('shares (000s)','shares',3), ('mn shares','shares',6),
 ('pure','pure',0), ('xbrli:pure','pure',0), ('ratio','pure',0), ('percent','pure',-2), ('%','pure',-2),
 ('bps','pure',-4), ('basis points','pure',-4))
"""
FACT = "entity_id, concept, common_unit, period_type, period_instant, period_start, period_end, dims"
FACTS = f"""
facts AS (SELECT DISTINCT f.id, f.entity_id, f.concept, l.common_unit, f.period_type, f.period_instant, f.period_start, f.period_end,
  CAST(list_sort(map_entries(f.dimensions)) AS VARCHAR) AS dims, {key("f.document_version_id")} AS version,
  printf('%.10g', CAST(f.value AS DOUBLE) * pow(10, coalesce(f.scale, 0) + l.power)) AS quantity,
  f.label, f.confidence, f.reported_or_derived, f.ingested_at
  FROM financial_facts f JOIN unit_labels l ON lower(trim(f.unit)) = l.label)
"""
REVIEWED = r"""
reviewed AS (SELECT DISTINCT id, regexp_replace(a, '[^0-9]', '', 'g') AS accession,
  CAST(CASE WHEN length(trim(as_of)) = 10 THEN trim(as_of) || 'T00:00:00Z' ELSE trim(as_of) END AS TIMESTAMPTZ) AS t
  FROM (SELECT id, as_of, unnest(documents_reviewed) AS a FROM manifest_entries)),
ranked AS (SELECT r.id, r.accession, r.t, d.*, row_number() OVER (PARTITION BY r.id, r.accession, r.t ORDER BY d.valid_from DESC, d.doc_id DESC) AS n
  FROM reviewed r JOIN (SELECT * RENAME (id AS document_id, accession AS filed_as) FROM documents) d
    ON regexp_replace(d.filed_as, '[^0-9]', '', 'g') = r.accession AND d.published_at <= r.t AND d.valid_from <= r.t AND (d.valid_to IS NULL OR r.t < d.valid_to))
"""
TREE = f"""
nodes AS (SELECT {key("id")} AS id, min({key("parent_id")}) AS parent, min(heading) AS heading FROM sections GROUP BY 1),
known AS (SELECT n.id, p.id AS parent, n.heading FROM nodes n LEFT JOIN nodes p ON n.parent = p.id),
above(id, anc) AS (SELECT id, parent FROM known WHERE parent IS NOT NULL UNION SELECT a.id, k.parent FROM above a JOIN known k ON a.anc = k.id WHERE k.parent IS NOT NULL),
ring AS (SELECT id FROM above WHERE id = anc),
lost AS (SELECT a.id, min(a.anc) AS root FROM above a JOIN ring r ON a.anc = r.id GROUP BY 1)
"""


def broken(name: str, field: str, at: str, parents: str, written: str) -> str:
    return f"""
SELECT DISTINCT '{name}' AS table_name, '{field}' AS field_name, {stamp("r.t", "%Y-%m")} AS ref_month, r.row_id, {spelled("r.k")} AS ref_id,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN p.written > r.t THEN 'late' WHEN p.gone <= r.t THEN 'deleted' END AS kind
FROM (SELECT id AS row_id, {key(field)} AS k, {at} AS t FROM {name}) r
LEFT JOIN (SELECT DISTINCT {key("id")} AS k, {written} AS written, valid_to AS gone FROM {parents}) p ON r.k = p.k
WHERE r.k IS NOT NULL AND (p.k IS NULL OR p.written > r.t OR p.gone <= r.t)"""


BROKEN = " UNION ALL ".join((
    broken("financial_facts", "source_span_id", "ingested_at", "source_spans", "ingested_at"),
    broken("financial_facts", "document_version_id", "ingested_at", "document_versions", "created_at"),
    broken("lane_candidates", "financial_fact_id", "created_at", "financial_facts", "ingested_at"),
))


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {REVIEWED} SELECT DISTINCT id, doc_id FROM ranked WHERE n = 1",
        "p1_attributes": f"""WITH {REVIEWED} SELECT DISTINCT id, accession, {stamp("t")} AS as_of, CAST(doc_id AS VARCHAR) AS doc_id, entity_id, form, lang, source,
  content_hash, CAST(period_end AS VARCHAR) AS period_end FROM ranked WHERE n = 1""",
        "p2_found": f"""WITH RECURSIVE {TREE},
below AS (SELECT anc AS id, count(*) AS n FROM above GROUP BY 1),
up AS (SELECT a.id, count(*) AS depth, max(CASE WHEN k.parent IS NULL THEN a.anc END) AS root FROM above a JOIN known k ON a.anc = k.id GROUP BY 1)
SELECT {spelled("k.id")} AS section_id, {spelled("coalesce(l.root, u.root, k.id)")} AS root_id,
  CAST(CASE WHEN l.id IS NOT NULL THEN -1 ELSE coalesce(u.depth, 0) END AS INTEGER) AS depth,
  CAST(CASE WHEN l.id IS NOT NULL THEN -1 ELSE coalesce(b.n, 0) END AS INTEGER) AS n_descendants
FROM known k LEFT JOIN lost l ON k.id = l.id LEFT JOIN up u ON k.id = u.id LEFT JOIN below b ON k.id = b.id""",
        "p2_paths": f"""WITH RECURSIVE {TREE},
below AS (SELECT anc AS id, count(*) + 1 AS n FROM above GROUP BY 1),
sized AS (SELECT k.id, k.parent, coalesce(k.heading, '') AS heading, coalesce(b.n, 1) AS n FROM known k LEFT JOIN below b ON k.id = b.id WHERE k.id NOT IN (SELECT id FROM lost)),
laid AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY parent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS off FROM sized),
walk(id, root, lo, n, path) AS (SELECT id, id, CAST(0 AS BIGINT), n, heading FROM laid WHERE parent IS NULL
  UNION ALL SELECT l.id, w.root, CAST(w.lo + l.off AS BIGINT), l.n, w.path || ' > ' || l.heading FROM walk w JOIN laid l ON l.parent = w.id)
SELECT {spelled("id")} AS section_id, {spelled("root")} AS root_id, lo AS range_from, CAST(lo + n AS BIGINT) AS range_to, path AS heading_path FROM walk""",
        "p3_found": f"""WITH {LABELS}, {FACTS},
dated AS (SELECT {FACT}, quantity, d.t, min(f.id) AS id FROM facts f
  JOIN (SELECT DISTINCT {key("id")} AS v, {key("document_id")} AS doc FROM document_versions) v ON f.version = v.v
  JOIN (SELECT {key("id")} AS doc, published_at AS t FROM documents) d ON d.doc = v.doc WHERE d.t IS NOT NULL GROUP BY {FACT}, quantity, d.t),
marked AS (SELECT *, quantity IS DISTINCT FROM lag(quantity) OVER (PARTITION BY {FACT} ORDER BY t, quantity) AS new FROM dated),
starts AS (SELECT *, lead(t) OVER (PARTITION BY {FACT} ORDER BY t, quantity) AS next, count(*) OVER (PARTITION BY {FACT}) AS n FROM marked WHERE new)
SELECT DISTINCT id AS fact_id, {stamp("t")} AS valid_from, coalesce({stamp("next")}, '') AS valid_to FROM starts WHERE n > 1""",
        "p5_found": BROKEN,
        "p5_report": f"""SELECT table_name, field_name, ref_month, kind, count(*) AS n_refs, count(DISTINCT ref_id) AS n_ids FROM ({BROKEN}) GROUP BY ALL""",
    }
