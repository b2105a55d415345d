"""Raw facts to normalized ones, quarantine, and items of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.decimals import let, shifted
from lodestrata.functions.ids import uuid5
from lodestrata.operators.history import neighbours, ranged
from lodestrata.operators.hot import TASK_ROWS, hot_keys
from lodestrata.operators.spans import span_code

# Number formats of inline facts (all others are refused), dashes that mean zero, and reasons for which a filing is set aside.
POINT_FORMATS, COMMA_FORMATS = ("num-dot-decimal", "numdotdecimal"), ("num-comma-decimal", "numcommadecimal")
ZERO_FORMATS, EMPTY_FORMATS = ("fixed-zero", "fixedzero", "zerodash", "numdash"), ("fixed-empty", "fixedempty")
FORMATS = (*POINT_FORMATS, *COMMA_FORMATS, *ZERO_FORMATS, *EMPTY_FORMATS)
DASHES = ("-", "‐", "–", "—", "−")
REASONS = ("UNKNOWN_CONTEXT", "UNKNOWN_FORMAT", "UNKNOWN_UNIT", "BAD_NUMBER", "BAD_PERIOD", "EMPTY_FACT_VALUE", "NONFINITE_FACT_VALUE", "FACT_CONFLICT", "EMPTY_DOCUMENT", "HASH_MISMATCH")
#: Namespace of the ids made here.
SPACE = "6ba7b8129dad11d180b400c04fd430c8"


def inline_value(raw: Column, form: Column, sign: Column, scale: Column) -> tuple[Column, Column]:
    """(value, code) of an inline fact: a plain decimal, fully scaled; a lone dash is zero, brackets and a sign negate.

    A fact without a format is written with a decimal point. UNKNOWN_FORMAT: outside FORMATS; EMPTY_FACT_VALUE: an empty text, or
    a format that declares there is no number (a null text is a BAD_NUMBER); NONFINITE_FACT_VALUE: NaN and infinities; BAD_NUMBER: no number.
    """
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(form, F.lit("num-dot-decimal")))), "^.*:", "")
    t = F.trim(raw)
    bracketed = t.rlike(r"^\(.*\)$")
    t = F.when(bracketed, F.trim(F.regexp_replace(t, r"^\((.*)\)$", "$1"))).otherwise(t)
    zero = t.isin(*DASHES) | name.isin(*ZERO_FORMATS)
    bare = F.translate(F.when(name.isin(*COMMA_FORMATS), F.translate(t, ",.", ".")).otherwise(F.translate(t, ",", "")), " \u00a0", "")
    finite = ~F.lower(bare).rlike("^[-+]?(s?nan|inf(inity)?)$")
    number = F.when(zero, F.lit("0")).otherwise(shifted(F.when(bare.rlike(r"^[-+0-9.eE]+$"), bare), F.coalesce(scale.try_cast("int"), F.lit(0))))
    turned = lambda n: F.when(n == "0", n).when(n.startswith("-"), F.substring(n, 2, 1 << 30)).otherwise(F.concat(F.lit("-"), n))
    flip = bracketed != F.coalesce(sign == "-", F.lit(False))
    code = F.when(~name.isin(*FORMATS), "UNKNOWN_FORMAT").when(name.isin(*EMPTY_FORMATS) | (bare == "") & ~name.isin(*ZERO_FORMATS), "EMPTY_FACT_VALUE")
    code = code.when(~zero & ~finite, "NONFINITE_FACT_VALUE").when(number.isNull(), "BAD_NUMBER")
    return F.when(code.isNull(), F.when(flip, let(number, turned)).otherwise(number)), code


def common_measure(measure: Column) -> Column:
    """A unit measure of an inline fact by its common name: currencies by ISO code, shares, pure, and money per share; others stay."""
    plain = F.regexp_replace(measure, "(?i)iso4217:|xbrli:", "")
    return F.when(plain.rlike("(?i)^[a-z]{3}$") & F.lower(measure).startswith("iso4217:"), F.upper(plain)).when(
        plain.rlike("(?i)^[a-z]{3}/shares$"), F.concat(F.upper(F.left(plain, F.lit(3))), F.lit("/shares"))
    ).when(F.lower(plain).isin("shares", "pure"), F.lower(plain)).otherwise(measure)


def inline_facts(parsed: DataFrame, id_col: str) -> DataFrame:
    """(id, ord, concept, value, unit, period, dims, entity, fact_key, code): the facts of parsed documents with their contexts and units.

    Contexts and units are looked up within the document's own row, so nothing is shuffled. ``code`` tells why a fact is no
    good: UNKNOWN_CONTEXT, UNKNOWN_UNIT, BAD_PERIOD (neither an instant nor a start and end in order), or that of :func:`inline_value`.
    Facts marked nil, and facts without a unit that are texts, aren't numbers and don't come out.
    """
    f = parsed.select(id_col, "contexts", "units", F.posexplode("facts").alias("ord", "f")).where(~F.col("f.nil"))
    context = F.get(F.filter("contexts", lambda c: c["id"] == F.col("f.context")), F.lit(0))
    unit = F.get(F.filter("units", lambda u: u["id"] == F.col("f.unit")), F.lit(0))
    f = f.where(F.col("f.unit").isNotNull()).select(id_col, "ord", "f", context.alias("c"), unit["measure"].alias("measure"))
    value, code = inline_value(F.col("f.raw"), F.col("f.format"), F.col("f.sign"), F.col("f.scale"))
    day = lambda n: F.col(f"c.{n}").try_cast("date")
    lasting = day("start") <= day("end")
    period = F.coalesce(day("instant").cast("string"), F.when(lasting, F.concat_ws("/", day("start").cast("string"), day("end").cast("string"))))
    kind = F.when(day("instant").isNotNull(), "instant").otherwise("duration")
    common = common_measure(F.col("measure"))
    code = F.when(F.col("c").isNull(), "UNKNOWN_CONTEXT").when(F.col("measure").isNull(), "UNKNOWN_UNIT").when(period.isNull(), "BAD_PERIOD").otherwise(code)
    dims = F.array_join(F.transform(F.array_sort(F.map_entries("c.dimensions")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    key = fact_key(F.col("f.concept"), common, kind, day("instant"), day("start"), day("end"), F.col("c.dimensions"))
    good = lambda c: F.when(code.isNull(), c)
    return f.select(id_col, "ord", F.col("f.concept").alias("concept"), good(value).alias("value"), common.alias("unit"), period.alias("period"), dims.alias("dims"), F.col("c.entity").alias("entity"), good(key).alias("fact_key"), code.alias("code"))


def fact_key(concept: Column, unit: Column, period_type: Column, instant: Column, start: Column, end: Column, dimensions: Column) -> Column:
    """Concept, unit, period and sorted dimensions as one text."""
    period = F.when(period_type == "instant", F.concat(F.lit("instant:"), instant.cast("string"))).otherwise(F.concat(F.lit("duration:"), start.cast("string"), F.lit(":"), end.cast("string")))
    dims = F.array_join(F.transform(F.array_sort(F.map_entries(dimensions)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.concat_ws("|", concept, F.coalesce(unit, F.lit("")), period, F.coalesce(dims, F.lit("")))


def job_key(*parts: Column) -> tuple[Column, Column]:
    """(key, valid): sha256 of the parts joined by bars, which none may hold."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | F.coalesce(p.contains("|"), F.lit(True))
    return F.when(~bad, F.sha2(F.concat_ws("|", *parts), 256)), ~bad


def first_seen(facts: DataFrame, document: str, key: str, order: str, value: str, id_col: str) -> DataFrame:
    """Adds ``canonical_id`` (the first fact of the key in its document), ``is_first`` and ``conflict`` (another value than the first's)."""
    w = Window.partitionBy(document, key).orderBy(order, id_col)
    first = F.first(F.struct(F.col(id_col).alias("id"), F.col(value).alias("value"))).over(w)
    out = facts.withColumn("__f", first)
    return out.select("*", F.col("__f.id").alias("canonical_id"), (F.col(id_col) == F.col("__f.id")).alias("is_first"), (~F.col("__f.value").eqNullSafe(F.col(value))).alias("conflict")).drop("__f")


def split_quarantine(rows: DataFrame, document: str, code: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): a document with any code is set aside whole, with its codes in order."""
    bad = rows.where(F.col(code).isNotNull()).groupBy(document).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return rows.join(bad.select(document), document, "left_anti"), bad


def index_items(spans: DataFrame, texts: DataFrame, facts: DataFrame, index_version: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejections) of passages and facts, each re-verified against the canonical text.

    Spans have (id, document_version_id, start_char, end_char, text_hash), texts
    (document_version_id, text), facts (id, source_span_id). Facts whose span isn't there are UNANCHORED_FACT.
    """
    t = spans.join(texts, "document_version_id", "left")
    passages = t.select(F.lit("passage").alias("kind"), F.col("id").alias("source_span_id"), F.lit(None).cast("string").alias("financial_fact_id"), "document_version_id", span_code(F.col("text"), F.col("start_char"), F.col("end_char"), F.col("text_hash")).alias("code"))
    seen = passages.select("source_span_id", "document_version_id", F.col("code").alias("span_code"), F.lit(True).alias("anchored"))
    fact_rows = facts.select(F.col("id").alias("financial_fact_id"), "source_span_id").join(seen, "source_span_id", "left")
    fact_rows = fact_rows.select(F.lit("fact").alias("kind"), "source_span_id", "financial_fact_id", "document_version_id", F.when(F.col("anchored").isNull(), "UNANCHORED_FACT").otherwise(F.col("span_code")).alias("code"))
    both = passages.unionByName(fact_rows)
    name = F.concat_ws("|", F.lit(index_version), F.col("kind"), F.coalesce("financial_fact_id", F.lit("-")), "source_span_id")
    items = both.where("code is null").drop("code").withColumn("item_id", uuid5(SPACE, name))
    return items, both.where("code is not null")


def value_links(facts: DataFrame, keys: list[str], order: list[str], value: str, id_col: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, link, prior): each fact against the one before it under its keys: new, repeats or restates, and which one.

    ``order`` ends in the unique id. Keys with very many facts are sorted range by range.
    """
    hot = hot_keys(facts, keys, task_rows)
    f = neighbours(ranged(facts, keys, order, hot, task_rows), keys, order, hot, before={"prior": id_col, "__value": value})
    link = F.when(F.col("prior").isNull(), "new").when(F.col("__value").eqNullSafe(F.col(value)), "repeats").otherwise("restates")
    return f.select(id_col, link.alias("link"), "prior")
