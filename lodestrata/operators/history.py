"""Histories of changing attributes: versions with the period each was valid (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.hot import TASK_ROWS, hot_keys
from lodestrata.plans.tables import cut


def ranged(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame | None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds __range: for keys in ``hot`` the number of the row's range in ``order``, else null.

    Ranges are cut by count, over the keys and all of ``order``, so that rows of one time part too.
    Their bounds come from a sample, which decides how even they are, not what is found. They are written, as
    a row must stay in its range.
    """
    if hot is None:
        return df.withColumn("__range", F.lit(None).cast("int"))
    full = df.join(hot, keys, "left_semi")
    n = max(1, -(-full.count() // task_rows))
    parted = cut(full.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))
    return df.join(hot, keys, "left_anti").withColumn("__range", F.lit(None).cast("int")).unionByName(parted)


def neighbours(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame | None, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """Adds to each row columns of the row before and after it in ``order`` within ``keys``.

    ``df`` comes from :func:`ranged`. ``before`` and ``after`` map new columns to the columns
    whose neighbouring value they get (null where there is no neighbour). The rows of keys
    in ``hot`` are sorted range by range, and the ends of ranges are
    linked over one row per key and range.
    """
    before, after = before or {}, after or {}
    take = list(dict.fromkeys([*before.values(), *after.values()]))
    cell = F.struct(F.lit(True).alias("__is"), *take)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()})
    w = Window.partitionBy(*keys, "__range").orderBy(*order)
    inner = df.withColumns({"__p": F.lag(cell).over(w), "__n": F.lead(cell).over(w)})
    ends = df.where(F.col("__range").isNotNull()).groupBy(*keys, "__range").agg(F.min_by(cell, F.struct(*order)).alias("__first"), F.max_by(cell, F.struct(*order)).alias("__last"))
    wk = Window.partitionBy(*keys).orderBy("__range")
    ends = ends.select(*keys, "__range", F.lag("__last").over(wk).alias("__pp"), F.lead("__first").over(wk).alias("__nn"))
    out = inner.join(ends, [*keys, "__range"], "left")
    cols = {n: F.when(F.col("__p").isNotNull(), F.col("__p")[c]).otherwise(F.col("__pp")[c]) for n, c in before.items()}
    cols |= {n: F.when(F.col("__n").isNotNull(), F.col("__n")[c]).otherwise(F.col("__nn")[c]) for n, c in after.items()}
    return out.withColumns(cols).drop("__p", "__n", "__pp", "__nn")


def running_sum(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame | None, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row; in ``hot`` keys within its range and, over one row per range, before it."""
    inner = F.sum(value).over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if hot is None:
        return df.withColumn(name, inner)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.where(F.col("__range").isNotNull()).groupBy(*keys, "__range").agg(F.sum(value).alias("__s"))
    sums = sums.select(*keys, "__range", F.sum("__s").over(earlier).alias("__b"))
    return df.withColumn(name, inner).join(sums, [*keys, "__range"], "left").withColumn(name, F.col(name) + F.coalesce("__b", F.lit(0))).drop("__b")


def running_max_before(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame | None, value: str, name: str) -> DataFrame:
    """Adds the greatest ``value`` of the rows before each, in ``hot`` keys within its range and over the ranges before it; null for the first."""
    inner = F.max(value).over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    if hot is None:
        return df.withColumn(name, inner)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.where(F.col("__range").isNotNull()).groupBy(*keys, "__range").agg(F.max(value).alias("__m"))
    tops = tops.select(*keys, "__range", F.max("__m").over(earlier).alias("__b"))
    return df.withColumn(name, inner).join(tops, [*keys, "__range"], "left").withColumn(name, F.greatest(name, "__b")).drop("__b")


def attribute_hash(attributes: list[str]) -> Column:
    """128-bit digest of all attributes together; nulls differ from every value."""
    return F.md5(F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}))


def islands(each: DataFrame, keys: list[str], attributes: list[str], aggregates: list[Column], task_rows: int) -> DataFrame:
    """(keys, version, valid_from, valid_to, attributes, aggregates): gaps and islands over ``each``.

    ``each`` has keys, __at, __hash and the attributes, one row per key, time and hash. In the order of
    time and hash a row whose hash differs from the one before is a mark; the running sum of
    marks numbers the versions of a key (from 1), each number's minimum time starts it, and the start of the
    next number ends it. Windows and groups lie on the keys, so all is one shuffle; hot keys are sorted and
    summed range by range.
    """
    order = ["__at", "__hash"]
    hot = hot_keys(each, keys, task_rows)
    marked = neighbours(ranged(each, keys, order, hot, task_rows), keys, order, hot, before={"__before": "__hash"})
    marked = marked.withColumn("__new", (~F.col("__before").eqNullSafe(F.col("__hash"))).cast("bigint"))
    numbered = running_sum(marked, keys, order, hot, "__new", "version")
    grouped = numbered.groupBy(*keys, "version").agg(F.min("__at").alias("valid_from"), *aggregates, *[F.first(a).alias(a) for a in attributes])
    grouped = ranged(grouped, keys, ["version"], hot, task_rows)
    return neighbours(grouped, keys, ["version"], hot, after={"valid_to": "valid_from"}).drop("__range")


def version_history(statements: DataFrame, keys: list[str], at: str, attributes: list[str], id_col: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The versions of each key: (keys, id, valid_from, valid_to, attributes, first, last).

    Statements (snapshots or updates) say what the attributes of a key were at a time.
    Statements that repeat the attributes of the one before form one version with it; a
    version is valid from its first statement to the first of the next (null: still valid).
    ``id`` is the smallest ``id_col`` among the statements of its first time, ``first`` and
    ``last`` tell whether a version has no predecessor or successor. Statements of one time
    that differ are ordered by the digest of their attributes and make versions of no
    length but the last. Statements without key or time don't count; repeated ones count once.
    """
    narrow = statements.select(*keys, F.col(at).alias("__at"), *[F.col(a) for a in attributes], attribute_hash(attributes).alias("__hash"), F.col(id_col).alias("__id"))
    narrow = narrow.where(F.col("__at").isNotNull() & F.coalesce(*[F.col(k) for k in keys]).isNotNull())
    each = cut(narrow.groupBy(*keys, "__at", "__hash").agg(F.min("__id").alias("__id"), *[F.first(a).alias(a) for a in attributes]))
    versions = islands(each, keys, attributes, [F.min_by("__id", "__at").alias("id")], task_rows)
    return versions.select(*keys, "id", "valid_from", "valid_to", *attributes, (F.col("version") == 1).alias("first"), F.col("valid_to").isNull().alias("last"))


def snapshots_history(snapshots: DataFrame, keys: list[str], at: str, attributes: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Islands over all snapshots, with the number of the version and of the snapshots in it.

    Columns: keys, version (from 1), valid_from, valid_to, snapshots, attributes; see :func:`islands`.
    """
    narrow = snapshots.select(*keys, F.col(at).alias("__at"), *attributes, attribute_hash(attributes).alias("__hash")).distinct()
    narrow = cut(narrow.where(F.col("__at").isNotNull()))
    return islands(narrow, keys, attributes, [F.count("*").alias("snapshots")], task_rows)
