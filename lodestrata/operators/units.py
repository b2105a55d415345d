"""Quantities in different units and scales, brought to common units.

The same quantity is told twice in many places: by facts that a filing presents in two ways,
by a payload's raw text and its columns. Such pairs link the unit labels of both sides; from many of
them the factor between two labels follows, and from label to label, starting at those that
are common units, how each of them converts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.decimals import plain_number, with_shifted
from lodestrata.functions.units import COMMON, payload_parts, read_label
from lodestrata.plans.tables import cut, remove

#: Links by which an estimate outvotes what a label says (as if the label had so many links of its own) and by which it is believed
#: where the label doesn't read; how far (in powers of ten) it may lie off a known conversion.
LEAST_LINKS, SNAP = 5, 0.02
#: Links between labels up to which one task follows them all; the result is the same beyond.
TASK_LINKS = 200_000

_READ = T.StructType([T.StructField("common_unit", T.StringType()), T.StructField("power", T.IntegerType()), T.StructField("times", T.IntegerType()), T.StructField("over", T.IntegerType()), T.StructField("literal", T.BooleanType())])
_PARTS = T.StructType([T.StructField(c, T.StringType()) for c in ("raw_number", "raw_label", "col_number", "col_label")])


@F.pandas_udf(_READ)
def _read_label(labels: pd.Series) -> pd.DataFrame:
    rows = []
    for x in labels:
        u = read_label(x)
        rows.append((None, None, None, None, bool(COMMON.match(x or ""))) if u is None else (u.common, u.power, u.times, u.over, bool(COMMON.match(x)) and u.common == x))
    return pd.DataFrame(rows, columns=["common_unit", "power", "times", "over", "literal"])


@F.pandas_udf(_PARTS)
def _read_parts(raw: pd.Series, value: pd.Series, unit: pd.Series, currency: pd.Series) -> pd.DataFrame:
    none = lambda x: None if x is None or x != x else x
    return pd.DataFrame([payload_parts(*map(none, r)) for r in zip(raw, value, unit, currency)], columns=["raw_number", "raw_label", "col_number", "col_label"])


def declared_units(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """(label, common_unit, power, times, over, literal) of each unit label in ``rows``, as it reads.

    Labels that don't read as one unit have nulls. The result is written: one row per label.
    """
    labels = rows.select(F.col(unit).alias("label")).where(F.col("label").isNotNull()).distinct()
    return cut(labels.select("label", _read_label("label").alias("u")).select("label", "u.*"))


def presented(rows: DataFrame, keys: Column, unit: str, value: str, scale: str) -> DataFrame:
    """(k, label, x): what each row says of the quantity ``keys`` stands for."""
    number = F.coalesce(F.col(value).try_cast("double"), plain_number(F.col(value)).try_cast("double")) * F.pow(F.lit(10.0), F.coalesce(F.col(scale), F.lit(0)))
    return rows.select(keys.alias("k"), F.col(unit).alias("label"), F.abs(number).alias("x"))


def source_links(said: DataFrame, declared: DataFrame) -> DataFrame:
    """(label, ref, ratio, spread, offset, links): labels compared over the same quantities.

    ``said`` comes from :func:`presented`; rows with equal ``k`` present one quantity. In each such group a label that is
    itself a common unit, else the first, is the reference to which every other label is
    compared (a star, not all pairs). ``ratio`` is the median of log10(reference / label),
    ``spread`` its quartile distance; ``offset`` follows from the medians on both sides and
    is given in quartile distances of the reference, 0 where the units differ by a factor.
    """
    literal = declared.select("label", "literal")
    each = said.where("label is not null and x > 0 and x < double('inf')").groupBy("k", "label").agg(F.min("x").alias("x")).join(literal, "label")
    stars = each.groupBy("k").agg(F.collect_list(F.struct((~F.col("literal")).alias("odd"), "label", "x")).alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("ref"), F.explode("all").alias("of")).where(F.col("of.label") != F.col("ref.label"))
    ratio = F.log10("ref.x") - F.log10("of.x")
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75])
    grouped = stars.groupBy(F.col("of.label").alias("label"), F.col("ref.label").alias("ref")).agg(quartiles(ratio).alias("q"), quartiles(F.col("ref.x")).alias("y"), quartiles(F.col("of.x")).alias("x"), F.count("*").alias("links"))
    grouped = grouped.withColumns({"ratio": F.col("q")[1], "spread": F.col("q")[2] - F.col("q")[0]})
    offset = (F.col("y")[1] - F.col("x")[1] * F.pow(F.lit(10.0), F.col("ratio"))) / F.nullif(F.col("y")[2] - F.col("y")[0], F.lit(0.0))
    return grouped.select("label", "ref", "ratio", "spread", offset.alias("offset"), "links")


def link_estimates(rows: DataFrame, keys: Column, unit: str, value: str, scale: str, declared: DataFrame) -> DataFrame:
    """:func:`source_links` of one table, whose rows with equal ``keys`` present one quantity."""
    return source_links(presented(rows, keys, unit, value, scale), declared)


def _passed_on(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, est_unit, est, est_links, hop): estimates passed on from ``known`` labels, level by level, in one task."""
    names = known.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=[*names, "ref", "ratio", "links"])])
        seen = {r.label: (r.est_unit, r.est, None, 0) for r in rows[rows["ref"].isna()].itertuples()}
        ways: dict[str, list[tuple[str, float, int]]] = {}
        for r in rows[rows["ref"].notna()].itertuples():
            ways.setdefault(r.ref, []).append((r.label, r.ratio, int(r.links)))
        frontier, hop = seen, 0
        while frontier:
            hop, found = hop + 1, {}
            for ref, (unit, est, weakest, _) in frontier.items():
                for label, ratio, links in ways.get(ref, ()):
                    if label not in seen:
                        way = (links if weakest is None else min(links, weakest), unit, est + ratio)
                        found[label] = max(found.get(label, way), way)
            frontier = {k: (unit, est, links, hop) for k, (links, unit, est) in found.items()}
            seen = seen | frontier
        yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=names).astype({"est_links": "Int64"})

    both = known.unionByName(edges.withColumn("hop", F.lit(None).cast("int")), allowMissingColumns=True)
    return both.select(*names, "ref", "ratio", "links").coalesce(1).mapInPandas(run, known.schema)


def _passed_on_by_hops(known: DataFrame, edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The same over all tasks, a join for each level, and the tables written for it."""
    frontier, seen, hop, parts = known, known, 0, []
    while not frontier.isEmpty():
        hop += 1
        there = frontier.select(F.col("label").alias("ref"), "est_unit", "est", "est_links")
        onward = edges.join(there, "ref").select("label", "est_unit", (F.col("est") + F.col("ratio")).alias("est"), F.least("links", "est_links").alias("est_links"), F.lit(hop).alias("hop"))
        best = onward.groupBy("label").agg(F.max_by(F.struct("est_unit", "est", "est_links", "hop"), F.struct("est_links", "est_unit", "est")).alias("b")).select("label", "b.*")
        frontier = cut(best.join(seen.select("label"), "label", "left_anti"))
        seen = seen.unionByName(frontier)
        parts.append(frontier)
    return seen, parts


def conversions(declared: DataFrame, estimates: DataFrame, least_links: int = LEAST_LINKS) -> DataFrame:
    """(label, common_unit, power, times, over, how, estimate, links): how each label converts.

    From the labels that are common units themselves estimates are passed on along the graph of
    links, in both directions, until no label is left that they reach; the weakest link of a way counts.
    They snap to the conversion a label declares, else to hours, minutes or weeks in days, else to a power of ten, where within
    :data:`SNAP`. A label that declares a unit counts as ``least_links`` links: beyond them the
    estimate decides. ``how`` is ``literal``, ``confirmed`` (declared and estimated alike), ``estimated`` (the links
    decide: the label doesn't read, or they outvote it), or ``declared`` (too few links, or they agree on nothing).
    """
    sure = estimates.where((F.col("spread") <= SNAP) & (F.abs(F.coalesce("offset", F.lit(0.0))) < 0.5)).select("label", "ref", "ratio", "links")
    edges = cut(sure.unionByName(sure.select(F.col("ref").alias("label"), F.col("label").alias("ref"), (-F.col("ratio")).alias("ratio"), "links")))
    known = declared.where("literal").select("label", F.col("common_unit").alias("est_unit"), F.lit(0.0).alias("est"), F.lit(None).cast("bigint").alias("est_links"), F.lit(0).alias("hop"))
    if edges.count() <= TASK_LINKS:
        seen, parts = _passed_on(known, edges), [edges]
    else:
        seen, parts = _passed_on_by_hops(known, edges)
        parts.append(edges)
    joined = declared.join(seen.where("hop > 0"), "label", "left")
    says = F.col("power") + F.log10(F.col("times") / F.col("over"))
    way = lambda p, t, o: F.struct(F.lit(p).cast("int").alias("power"), F.lit(t).alias("times"), F.lit(o).alias("over"))
    at = lambda x: F.abs(F.col("est") - x) <= SNAP
    in_days = F.col("est_unit") == "days"
    snapped = F.when(at(says) & (F.col("common_unit") == F.col("est_unit")), F.struct("power", "times", "over"))
    for times, over in ((7, 1), (1, 24), (1, 1440)):
        snapped = snapped.when(in_days & at(F.log10(F.lit(times / over))), way(0, times, over))
    snapped = snapped.when(at(F.round("est")), way(0, 1, 1).withField("power", F.round("est").cast("int")))
    joined = joined.withColumns({"snapped": snapped, "agrees": at(says) & (F.col("common_unit") == F.col("est_unit"))})
    unread = F.col("common_unit").isNull()
    outvoted = F.col("snapped").isNotNull() & (F.col("est_links") > least_links)
    how = F.when(F.col("literal"), "literal").when(F.col("agrees"), "confirmed").when(outvoted, "estimated").when(~unread, "declared")
    linked = how == "estimated"
    pick = lambda c: F.when(linked, F.col(f"snapped.{c}")).otherwise(F.col(c)).alias(c)
    unit = F.when(linked, F.col("est_unit")).otherwise(F.col("common_unit")).alias("common_unit")
    found = cut(joined.select("label", unit, pick("power"), pick("times"), pick("over"), how.alias("how"), F.col("est").alias("estimate"), F.col("est_links").alias("links")).where(F.col("common_unit").isNotNull()))
    for x in parts:
        remove(x)
    return found


def in_common_units(rows: DataFrame, conversion: DataFrame, unit: str = "unit", value: str = "value", scale: str = "scale") -> DataFrame:
    """``rows`` with ``common_unit`` and ``common_value`` (exact plain decimal text).

    Rows whose unit doesn't convert have nulls there, those whose value is no number a null
    value; a null scale is 0. ``conversion`` has one row per label and is small beside the rows; Spark
    broadcasts it only below its own size threshold.
    """
    known = conversion.select(F.col("label").alias("__label"), "common_unit", F.col("power").alias("__p"), F.col("times").alias("__t"), F.col("over").alias("__o"))
    joined = rows.join(known, rows[unit] == known["__label"], "left")
    return with_shifted(joined, "common_value", value, F.coalesce(F.col(scale), F.lit(0)) + F.col("__p"), F.col("__t"), F.col("__o")).drop("__label", "__p", "__t", "__o")


def payload_sides(payloads: DataFrame) -> DataFrame:
    """``payloads`` (raw_value, value, unit, currency, scale) with raw_number, raw_label, col_number, col_label; see ``functions.units.payload_parts``."""
    return payloads.withColumn("__q", _read_parts("raw_value", "value", "unit", "currency")).select("*", "__q.*").drop("__q")


def payload_presentations(sides: DataFrame, id_col: str) -> DataFrame:
    """(k, label, x): each payload as its raw text and as its columns tell it."""
    key = F.xxhash64(F.lit("payload"), id_col)
    raw = presented(sides.withColumn("__none", F.lit(0)), key, "raw_label", "raw_number", "__none")
    return raw.unionByName(presented(sides, key, "col_label", "col_number", "scale"))


def payload_quantities(sides: DataFrame, conversion: DataFrame) -> DataFrame:
    """``sides`` (from :func:`payload_sides`) with common_unit and common_value.

    What the raw text says counts where its label converts, else the columns.
    """
    known = conversion.select("label", "common_unit", F.col("power").alias("__p"), F.col("times").alias("__t"), F.col("over").alias("__o"))
    named = lambda side: known.select(F.col("label").alias(side), F.struct("common_unit", "__p", "__t", "__o").alias(f"__{side}"))
    joined = sides.join(named("raw_label"), "raw_label", "left").join(named("col_label"), "col_label", "left")
    from_raw = F.col("__raw_label").isNotNull()
    chosen = F.when(from_raw, F.struct(F.col("raw_number").alias("number"), F.lit(0).alias("scale"), F.col("__raw_label").alias("by")))
    chosen = chosen.otherwise(F.struct(F.col("col_number").alias("number"), F.coalesce(F.col("scale").cast("int"), F.lit(0)).alias("scale"), F.col("__col_label").alias("by")))
    told = joined.withColumn("__c", chosen).select(*sides.columns, F.col("__c.by.common_unit").alias("common_unit"), F.col("__c.number").alias("__number"), (F.col("__c.scale") + F.col("__c.by.__p")).alias("__shift"), F.col("__c.by.__t").alias("__by"), F.col("__c.by.__o").alias("__per"))
    out = with_shifted(told, "common_value", "__number", F.col("__shift"), F.col("__by"), F.col("__per"))
    return out.withColumn("common_unit", F.when(F.col("common_value").isNotNull(), F.col("common_unit"))).drop("__number", "__shift", "__by", "__per")
