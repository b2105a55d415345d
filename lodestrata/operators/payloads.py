"""Structured metric payloads: normalizing, identity, accounting checks, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.decimals import let, shifted

TOLERANCE = "0.005"


def sorted_map(m: Column) -> Column:
    """A map with trimmed values in the order of its keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(m, lambda k, v: F.trim(v)))))


def canonical_magnitude(value: Column, scale: Column) -> Column:
    """``digits e exponent`` of value x 10^scale, alike for all ways to write it; zero is ``0e0``."""

    def token(t: Column) -> Column:
        fraction = F.regexp_extract(t, r"\.([0-9]+)$", 1)
        digits = F.regexp_replace(F.regexp_replace(t, "[.-]", ""), "^0+", "")
        zeros = F.length(F.regexp_extract(digits, "(0*)$", 1))
        sign = F.when(t.startswith("-"), "-").otherwise("")
        return F.when(t == "0", "0e0").otherwise(F.concat(sign, F.left(digits, F.length(digits) - zeros), F.lit("e"), (zeros - F.length(fraction)).cast("string")))

    return let(shifted(value, F.coalesce(scale, F.lit(0))), token)


def fingerprint(*parts: Column) -> Column:
    """sha256 over parts, nulls told from empty texts."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def sign_of(value: Column) -> Column:
    d = value.try_cast("double")
    return F.when(d > 0, "positive").when(d < 0, "negative").when(d == 0, "zero")


def smallest_scale(rows: Column) -> Column:
    """The least exponent of several bounds, to which all are brought."""
    return F.array_min(rows)


def near(a: Column, b: Column) -> Column:
    """Equal within half a percent of the larger side."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(float(TOLERANCE))


def comparability_key(fields: list[str]) -> Column:
    """``field=value|...`` of trimmed values; null where one is missing."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.coalesce(F.trim(f), F.lit("")).eqNullSafe(F.lit(""))
    return F.when(~missing, F.concat_ws("|", *[F.concat(F.lit(f"{f}="), F.trim(f)) for f in fields]))


def duplicate_groups(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, first_id, n): keys with two or more different ids."""
    return rows.groupBy(*keys).agg(F.min(id_col).alias("first_id"), F.countDistinct(id_col).alias("n")).where("n > 1")


def conflict_groups(rows: DataFrame, keys: list[str], id_col: str, print_col: str) -> DataFrame:
    """(keys, n_members, n_values, kind): at least two members; they disagree or repeat each other."""
    g = rows.groupBy(*keys).agg(F.countDistinct(id_col).alias("n_members"), F.countDistinct(print_col).alias("n_values")).where("n_members > 1")
    return g.withColumn("kind", F.when(F.col("n_values") > 1, "conflict").otherwise("duplicate"))


def segments_total(rows: DataFrame, slice_cols: list[str], part: Column, total: Column) -> DataFrame:
    """(slice, parts, total, n_parts, balanced): do two or more parts sum to the one total, within tolerance?"""
    g = rows.groupBy(*slice_cols).agg(F.round(F.sum(part), 4).alias("parts"), F.max(total).alias("total"), F.count(part).alias("n_parts"), F.countDistinct(total).alias("__totals"))
    return g.where("n_parts > 1 and __totals = 1").drop("__totals").withColumn("balanced", near(F.col("parts"), F.col("total")))


def identity_balance(rows: DataFrame, slice_cols: list[str], metric: str, value: str, whole: str, plus: str, minus: str) -> DataFrame:
    """(slice, expected, actual, balanced): whole = plus - |minus|, where each is given once in a slice."""
    one = lambda m: F.when(F.count_if(F.col(metric) == m) == 1, F.max(F.when(F.col(metric) == m, F.col(value))))
    g = rows.groupBy(*slice_cols).agg(one(whole).alias("actual"), (one(plus) - F.abs(one(minus))).alias("expected"))
    return g.where("actual is not null and expected is not null").withColumn("balanced", near(F.col("actual"), F.col("expected")))


def payload_errors(checks: dict[str, Column]) -> Column:
    """Codes of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def unknown_keys(raw: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object beyond the allowed ones; null where it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(a) for a in allowed])))


def alias_hits(definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(metric_id, other): definitions that are an alias of another metric.

    Definitions have (metric_id, definition), aliases (metric_id, alias).
    """
    a = aliases.select(F.col("metric_id").alias("other"), F.lower(F.trim("alias")).alias("__a"))
    return definitions.join(a, F.lower(F.trim("definition")) == F.col("__a")).where(F.col("metric_id") != F.col("other")).select("metric_id", "other").distinct()


def part_within_whole(rows: DataFrame, slice_cols: list[str], metric: str, value: str, part: str, whole: str) -> DataFrame:
    """(slice, within): is |part| no more than |whole|, half a percent aside, where each is given once?"""
    one = lambda m: F.when(F.count_if(F.col(metric) == m) == 1, F.abs(F.max(F.when(F.col(metric) == m, F.col(value)))))
    g = rows.groupBy(*slice_cols).agg(one(part).alias("p"), one(whole).alias("w")).where("p is not null and w is not null")
    return g.select(*slice_cols, ((F.col("p") <= F.col("w")) | near(F.col("p"), F.col("w"))).alias("within"))


def merged_counters(log: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters that only grow, from a log in any order."""
    return log.groupBy(key).agg(*[F.max(c).alias(c) for c in counters])


def digest_uuid(text: Column) -> Column:
    """The first 32 hexadecimal digits of a sha256 in the form of a UUID (which it is in form only)."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def canonical_hash(columns: list[str]) -> Column:
    """sha256 of the columns as one JSON object: sorted keys, no blanks, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def period_text(kind: Column, instant: Column, start: Column, end: Column) -> Column:
    """A day, or ``start/end``; null where the parts given don't make a period of its kind."""
    at = F.when((kind == "instant") & start.isNull(), instant.cast("string"))
    return F.coalesce(at, F.when((kind == "duration") & instant.isNull() & (start <= end), F.concat_ws("/", start.cast("string"), end.cast("string"))))


def kind_of(name: Column, kinds: dict[str, tuple[str, ...]], other: str) -> Column:
    """The kind that lists a name, else ``other``."""
    out = F.lit(None).cast("string")
    for kind, names in kinds.items():
        out = F.coalesce(out, F.when(name.isin(*names), kind))
    return F.coalesce(out, F.lit(other))


def unit_mismatch(metric: Column, unit: Column, metric_kinds: dict[str, tuple[str, ...]], unit_kinds: dict[str, tuple[str, ...]], other: str) -> Column:
    """UNIT_MISMATCH where a given unit isn't of the kind of its metric; what is in no list, and a null metric, is of kind ``other``."""
    return F.when(unit.isNotNull() & (kind_of(F.lower(unit), unit_kinds, other) != kind_of(metric, metric_kinds, other)), "UNIT_MISMATCH")


#: What texts of each JSON type look like.
JSON_TYPES = {"integer": "^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?$", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}


def schema_errors(raw: Column, schema: dict) -> Column:
    """Codes ``key:RULE`` in the order of the schema for what a JSON object breaks; ``:TYPE`` where it is no object.

    Known of JSON schema are type, required, properties, enum, minLength, minimum and maximum. A null value counts as missing; a string
    is told from other types by its text only, so "5" passes as an integer.
    """
    known = F.json_object_keys(raw)
    codes = [F.when(known.isNull(), F.lit(":TYPE"))]
    for name, rule in schema.get("properties", {}).items():
        v = F.get_json_object(raw, f"$.{name}")
        n = v.try_cast("double")
        if name in schema.get("required", []):
            codes.append(F.when(known.isNotNull() & v.isNull(), F.lit(f"{name}:REQUIRED")))
        if rule.get("type") in JSON_TYPES:
            codes.append(F.when(~v.rlike(JSON_TYPES[rule["type"]]), F.lit(f"{name}:TYPE")))
        if "enum" in rule:
            codes.append(F.when(~v.isin(*[str(x) for x in rule["enum"]]), F.lit(f"{name}:ENUM")))
        if "minLength" in rule:
            codes.append(F.when(F.length(v) < rule["minLength"], F.lit(f"{name}:MIN_LENGTH")))
        if "minimum" in rule:
            codes.append(F.when(n < rule["minimum"], F.lit(f"{name}:MINIMUM")))
        if "maximum" in rule:
            codes.append(F.when(n > rule["maximum"], F.lit(f"{name}:MAXIMUM")))
    return F.array_compact(F.array(*codes))
