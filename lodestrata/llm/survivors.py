"""The best representative of each group of duplicate records, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def late_first(c: Column) -> Column:
    """Text whose order is the reverse of ``c``'s, for hexadecimal ids in small letters or capitals."""
    return F.translate(F.lower(c), "0123456789abcdef", "fedcba9876543210")


def survivors(rows: DataFrame, keys: list[str], id_col: str, rank: list[Column], fields: list[str]) -> DataFrame:
    """One row per group of two or more ids: (keys, group_id, survivor_id, n, fields..., fields_from...).

    ``rank`` lists columns by which greater is better; the smallest id breaks ties. The
    survivor is the best record; each field comes from the best record that has a value
    (null and, for text, blank don't count), and ``<field>_from`` names it, null where no record has one. All
    is one aggregation of maxima over composite structs (has a value, rank, reversed id,
    id, value), combined before the shuffle, so a group of any size stays small. Rows with
    a null in any key belong to no group; repeated rows count once.
    """
    tie = [*[r.alias(f"r{i}") for i, r in enumerate(rank)], late_first(F.col(id_col)).alias("tie"), F.col(id_col).alias("id")]

    def best(field: str) -> Column:
        c = F.col(field)
        kind = rows.schema[field].dataType.typeName()
        some = c.isNotNull() & ((F.trim(c) != "") if kind == "string" else F.lit(True))
        return F.max(F.struct(some.alias("some"), *tie, F.when(some, c).alias("value"))).alias(f"__{field}")

    grouped = rows.where(F.concat(*[F.col(k).isNotNull().cast("string") for k in keys]).contains("false") == F.lit(False)).groupBy(*keys).agg(
        F.min(id_col).alias("group_id"), F.max(id_col).alias("__other"), F.max(F.struct(*tie)).alias("__best"), F.count("*").alias("n"), *[best(f) for f in fields]
    )
    grouped = grouped.where(F.col("group_id") != F.col("__other"))
    per_field = []
    for f in fields:
        per_field += [F.col(f"__{f}.value").alias(f), F.when(F.col(f"__{f}.some"), F.col(f"__{f}.id")).alias(f"{f}_from")]
    return grouped.select(*keys, "group_id", F.col("__best.id").alias("survivor_id"), "n", *per_field)
