"""Queries of the general training-data problems (p1, p2, p3, p5, p6) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import accession_key, packed, unpacked, uuid_key, uuid_text
from lodestrata.operators import hierarchy as H
from lodestrata.operators.asof import asof_attributes, iso_instant
from lodestrata.operators.history import version_history
from lodestrata.operators.references import broken_references, reference_report
from lodestrata.operators.units import conversions, declared_units, in_common_units, payload_presentations, payload_quantities, payload_sides, presented, source_links
from lodestrata.plans.tables import cut, table

STAMP = "yyyy-MM-dd HH:mm:ss"


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, accession, as_of) of each manifest entry and accession it reviewed."""
    m = table(spark, sf_dir, "manifest_entries").select("id", iso_instant(F.col("as_of")).alias("as_of"), F.explode("documents_reviewed").alias("a"))
    return m.select("id", accession_key(F.col("a")).alias("accession"), "as_of")


def document_versions_known(spark: SparkSession, sf_dir: str, attributes: list[str]) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("published_at is not null and valid_from is not null")
    known = F.greatest("published_at", "valid_from").alias("known_from")
    return d.select(accession_key(F.col("accession")).alias("accession"), known, F.col("valid_to").alias("known_to"), F.col("valid_from").alias("rank_from"), F.col("doc_id").alias("rank_id"), *attributes)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = document_versions_known(spark, sf_dir, ["doc_id"])
    found = asof_attributes(reviewed(spark, sf_dir), versions, "accession", "as_of", "known_from", "known_to", ["rank_from", "rank_id"], ["doc_id"])
    return found.select("id", F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


P1_ATTRIBUTES = ["doc_id", "entity_id", "form", "lang", "source", "content_hash", "period_end"]


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = document_versions_known(spark, sf_dir, P1_ATTRIBUTES)
    return asof_attributes(reviewed(spark, sf_dir), versions, "accession", "as_of", "known_from", "known_to", ["rank_from", "rank_id"], P1_ATTRIBUTES).withColumn("as_of", F.date_format("as_of", STAMP)).distinct()


def section_id(c: str) -> Column:
    return uuid_text(unpacked(F.col(c)))


def section_links(spark: SparkSession, sf_dir: str, headings: bool) -> DataFrame:
    s = table(spark, sf_dir, "sections")
    return H.links(s, packed(uuid_key(F.col("id"))), packed(uuid_key(F.col("parent_id"))), F.col("heading") if headings else None, F.xxhash64("document_version_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(section_links(spark, sf_dir, headings=False))
    return tree.select(section_id("id").alias("section_id"), section_id("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.col("n_descendants").cast("int").alias("n_descendants"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full heading path and preorder range of each section in a tree."""
    tree = H.hierarchy(section_links(spark, sf_dir, headings=True), with_paths=True).where(~F.col("looped"))
    path = F.concat_ws(" > ", F.transform("path", lambda h: F.coalesce(h, F.lit(""))))
    return tree.select(section_id("id").alias("section_id"), section_id("root").alias("root_id"), F.col("lo").cast("bigint").alias("range_from"), F.col("hi").cast("bigint").alias("range_to"), path.alias("heading_path"))


def fact_parts() -> list[Column]:
    """What makes a fact the same fact, besides its unit and filing; nulls are told from every value."""
    texts = [F.coalesce(x.cast("string"), F.lit("\x01")) for x in map(F.col, ("entity_id", "concept", "period_type", "period_instant", "period_start", "period_end"))]
    none = F.array(F.struct(F.lit("\x01").alias("key"), F.lit("\x01").alias("value")))
    return [*texts, F.coalesce(F.sort_array(F.map_entries("dimensions")), none)]


def fact_key(*more: Column) -> Column:
    """128-bit digest of a fact's identity, as two hashes of the columns themselves."""
    return F.struct(*[F.xxhash64(F.lit(seed), *fact_parts(), *[F.coalesce(m, F.lit("\x01")) for m in more]).alias(f"h{seed}") for seed in (1, 2)])


def version_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, published_at) of each document version that leads to a document."""
    v = table(spark, sf_dir, "document_versions").select(uuid_key(F.col("id")).alias("version"), uuid_key(F.col("document_id")).alias("document")).distinct()
    d = table(spark, sf_dir, "documents").select(uuid_key(F.col("id")).alias("document"), "published_at")
    return v.join(d, "document").groupBy("version").agg(F.min("published_at").alias("published_at"))


def dated_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact, id, quantity, published_at): each statement of a fact with its date."""
    facts = table(spark, sf_dir, "financial_facts")
    said = in_common_units(facts, unit_conversions(spark, sf_dir)).where("common_value is not null")
    said = said.select(fact_key(F.col("common_unit")).alias("fact"), "id", F.col("common_value").alias("quantity"), uuid_key(F.col("document_version_id")).alias("version"))
    return said.join(version_dates(spark, sf_dir), "version").drop("version")


def p3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_history(dated_quantities(spark, sf_dir), ["fact"], "published_at", ["quantity"], "id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = p3_versions(spark, sf_dir).where("not (first and last)")
    return v.select(F.col("id").alias("fact_id"), F.date_format("valid_from", STAMP).alias("valid_from"), F.coalesce(F.date_format("valid_to", STAMP), F.lit("")).alias("valid_to")).distinct()


def p5_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, lanes = table(spark, sf_dir, "financial_facts"), table(spark, sf_dir, "lane_candidates")
    parent = lambda df, written: df.select(uuid_key(F.col("id")).alias("key"), F.col(written).alias("written"), F.col("valid_to").alias("gone"))
    fields = [
        ("financial_facts", "source_span_id", facts, "ingested_at", parent(table(spark, sf_dir, "source_spans"), "ingested_at")),
        ("financial_facts", "document_version_id", facts, "ingested_at", parent(table(spark, sf_dir, "document_versions"), "created_at")),
        ("lane_candidates", "financial_fact_id", lanes, "created_at", parent(facts, "ingested_at")),
    ]
    out = None
    for name, field, rows, at, parents in fields:
        refs = rows.select(F.col("id").alias("row_id"), uuid_key(F.col(field)).alias("key"), F.col(at).alias("t")).where("key is not null")
        found = broken_references(refs, parents).select(
            F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), F.date_format("t", "yyyy-MM").alias("ref_month"), "row_id", uuid_text(F.col("key")).alias("ref_id"), "kind"
        )
        out = found if out is None else out.unionByName(found)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_broken(spark, sf_dir).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_report(p5_broken(spark, sf_dir))


def payload_sides_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_sides(table(spark, sf_dir, "kpi_payloads").select("id", "raw_value", "value", "unit", "currency", "scale").distinct())


def unit_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(labels, said): all unit labels of facts, payload columns and raw texts, and what they say of the same quantities.

    A filing that presents a fact twice, and a payload with its raw text and its columns, say one quantity in two ways.
    """
    facts, sides = table(spark, sf_dir, "financial_facts"), cut(payload_sides_of(spark, sf_dir))
    labels = facts.select("unit").unionByName(sides.select(F.explode(F.array("raw_label", "col_label")).alias("unit")))
    same = F.xxhash64(*fact_parts(), F.coalesce(uuid_key(F.col("document_version_id")), F.lit("\x01")))
    return labels, presented(facts, same, "unit", "value", "scale").unionByName(payload_presentations(sides, "id"))


def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each unit label of facts and payloads converts, by the links between them and what they say."""
    labels, said = unit_sources(spark, sf_dir)
    declared = declared_units(labels)
    return conversions(declared, source_links(said, declared))


def p6_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_conversions(spark, sf_dir)


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the links alone tell: each label with as many links as outvote it, its meaning unread unless it is a common unit itself."""
    labels, said = unit_sources(spark, sf_dir)
    declared = declared_units(labels)
    says = declared.where("not literal").select("label", F.col("common_unit").alias("declared_unit"), (F.col("power") + F.log10(F.col("times") / F.col("over"))).alias("says"))
    blank = declared.select("label", *[F.when(F.col("literal"), F.col(c)).alias(c) for c in ("common_unit", "power", "times", "over")], "literal")
    found = conversions(blank, source_links(said, declared)).where("how = 'estimated'").join(says, "label", "left")
    right = (F.col("declared_unit") == F.col("common_unit")) & (F.abs(F.col("says") - F.col("estimate")) < 0.1)
    return found.select("label", "common_unit", "power", "times", "over", "links", right.alias("as_declared"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = unit_conversions(spark, sf_dir)
    odd = in_common_units(table(spark, sf_dir, "financial_facts").select("id", "unit", "scale", "value"), known)
    odd = odd.where((F.col("unit") != F.col("common_unit")) | (F.coalesce("scale", F.lit(0)) != 0))
    kpi = payload_quantities(payload_sides_of(spark, sf_dir), known)
    cols = lambda df, name: df.where("common_value is not null").select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), "common_unit", "common_value")
    return cols(odd, "financial_facts").unionByName(cols(kpi, "kpi_payloads")).distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_attributes, p2_found, p2_paths, p3_found, p5_found, p5_report, p6_found, p6_units, p6_linked)}
