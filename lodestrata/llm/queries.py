"""Queries of the text problems (p4, p7 to p10) on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import uuid_key
from lodestrata.llm import leakage, pieces, prose, survivors, tokens
from lodestrata.operators.units import in_common_units
from lodestrata.plans.problems import fact_key, unit_conversions
from lodestrata.plans.problems_sql import FACT, FACTS, LABELS
from lodestrata.plans.tables import cut, table

#: Size of a piece and what consecutive pieces share, in characters.
LIMIT, OVERLAP = 1000, 100
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Consecutive words of an evaluation item that make a leak.
LEAK_WORDS = 12


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.passage_boundaries(table(spark, sf_dir, "passage_candidates"), "source_span_id", "content", LIMIT)
    return found.select(F.col("id").alias("source_span_id"), "boundary")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.passage_pieces(table(spark, sf_dir, "passage_candidates"), "source_span_id", "content", "start_char", LIMIT, OVERLAP).withColumnRenamed("id", "source_span_id")


def duplicate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "financial_facts")
    fields = list(FIELD_GIVEN)
    known = in_common_units(facts, unit_conversions(spark, sf_dir)).where("common_unit is not null")
    known = known.select("id", uuid_key(F.col("document_version_id")).alias("version"), fact_key(F.col("common_unit")).alias("fact"), "ingested_at", *fields)
    rank = [F.coalesce("confidence", F.lit(-1.0)), (F.col("reported_or_derived") == "reported").cast("int"), F.col("ingested_at")]
    return survivors.survivors(known, ["version", "fact"], "id", rank, fields)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_survivors(spark, sf_dir).select("group_id", "survivor_id", F.coalesce("label_from", F.lit("")).alias("label_from"))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group, built field by field."""
    return duplicate_survivors(spark, sf_dir).drop("version", "fact", "n")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", tokens.vocabulary_path(VOCABULARY))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(spark, table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", LEAK_WORDS)


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each item leaked into."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def prose_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(prose.document_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = prose_statistics(spark, sf_dir)
    return prose.no_prose(table(spark, sf_dir, "documents"), "doc_id", "text", stats, prose.fit_prose(stats)).select(F.col("id").alias("doc_id"), "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each document, its distance from its language's prose, and each one's part in it."""
    stats = prose_statistics(spark, sf_dir)
    return prose.outlierness(stats, prose.fit_prose(stats)).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_pieces, p7_found, p7_records, p8_ids, p9_found, p9_items, p10_found, p10_statistics)}


WHITE = r"[\x02 \t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The carriage return of a pair is turned into \x02, which counts as blank: RE2 would else take the pair for two breaks.
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANK = r"[\x02 \t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"^{WHITE}+|{WHITE}+$"


def fits(cut_text: str) -> str:
    return f"list_max(list_transform(string_split({cut_text}, chr(1)), lambda x: length(regexp_replace(x, '{STRIP}', '', 'g')))) <= {LIMIT}"


#: Fields of a record, and when it gives them.
FIELD_GIVEN = {"label": "trim(label) <> ''", "confidence": "confidence IS NOT NULL", "source_span_id": "trim(source_span_id) <> ''", "reported_or_derived": "trim(reported_or_derived) <> ''", "common_value": "common_value IS NOT NULL"}


def oracle_sql() -> dict[str, str]:
    paragraph = rf"regexp_replace(replace(content, chr(13) || chr(10), chr(2) || chr(10)), '{BREAK}({BLANK}*{BREAK})+', chr(1), 'g')"
    line = rf"regexp_replace({paragraph}, '{BREAK}', chr(1), 'g')"
    sentence = rf"regexp_replace({line}, '([.!?][''\"’”»)\]}}›]*){WHITE}+', '\1' || chr(1), 'g')"
    word = rf"regexp_replace({sentence}, '{WHITE}+', chr(1), 'g')"
    return {
        "p4_found": f"""SELECT DISTINCT source_span_id, CASE WHEN {fits(paragraph)} THEN 'paragraph' WHEN {fits(line)} THEN 'line'
  WHEN {fits(sentence)} THEN 'sentence' WHEN {fits(word)} THEN 'word' ELSE 'none' END AS boundary FROM passage_candidates WHERE length(content) > {LIMIT}""",
        "p7_found": f"""WITH {LABELS}, {FACTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY version, {FACT} ORDER BY confidence DESC NULLS LAST, CASE reported_or_derived WHEN 'reported' THEN 0 ELSE 1 END, ingested_at DESC, id) AS n FROM facts WHERE version IS NOT NULL)
SELECT min(id) AS group_id, arg_min(id, n) AS survivor_id, coalesce(arg_min(id, n) FILTER (trim(label) <> ''), '') AS label_from
FROM ranked GROUP BY version, {FACT} HAVING count(DISTINCT id) > 1""",
        "p7_records": f"""WITH {LABELS}, {FACTS}, shifts AS (SELECT DISTINCT f.id, f.source_span_id, f.value LIKE '-%' AS negative, replace(replace(f.value, '-', ''), '.', '') AS digits,
  coalesce(f.scale, 0) + l.power - CASE WHEN contains(f.value, '.') THEN length(split_part(f.value, '.', 2)) ELSE 0 END AS e FROM financial_facts f JOIN unit_labels l ON lower(trim(f.unit)) = l.label),
padded AS (SELECT *, CASE WHEN e >= 0 THEN digits || repeat('0', e) || '.' ELSE left(lpad(digits, greatest(length(digits), 1 - e)::INTEGER, '0'), greatest(length(digits), 1 - e) + e) || '.' || right(lpad(digits, greatest(length(digits), 1 - e)::INTEGER, '0'), -e) END AS t FROM shifts),
told AS (SELECT id, source_span_id, CASE WHEN regexp_full_match(digits, '0*') THEN '0' ELSE CASE WHEN negative THEN '-' ELSE '' END || regexp_replace(rtrim(rtrim(t, '0'), '.'), '^0+([0-9])', '\\1') END AS common_value FROM padded),
ranked AS (SELECT f.*, t.source_span_id, t.common_value, row_number() OVER (PARTITION BY version, {FACT} ORDER BY confidence DESC NULLS LAST, CASE reported_or_derived WHEN 'reported' THEN 0 ELSE 1 END, ingested_at DESC, f.id) AS n FROM facts f JOIN told t ON f.id = t.id WHERE version IS NOT NULL)
SELECT min(id) AS group_id, arg_min(id, n) AS survivor_id, {", ".join(f"arg_min({c}, n) FILTER ({w}) AS {c}, arg_min(id, n) FILTER ({w}) AS {c}_from" for c, w in FIELD_GIVEN.items())}
FROM ranked GROUP BY version, {FACT} HAVING count(DISTINCT id) > 1""",
    }
