"""Keys that hold too many rows for one task: finding them, and joining on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.tables import cut

BUCKETS = 1 << 16
#: Rows of one key up to which one task takes them all; hot keys are parted into about as many.
TASK_ROWS = 100_000


def hot_counts(df: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """(keys, __rows): the keys with more than ``most`` rows and their number, or null where there are none.

    Rows are first counted in hash buckets, which costs a shuffle of at most BUCKETS rows a
    task; only keys in buckets beyond ``most`` are then counted each. There are at most
    rows / most such keys; they are written, so that their size is known to later joins.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = df.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__rows")).where(F.col("__rows") > most).select("__bucket")
    if full.count() == 0:
        return None
    counted = df.withColumn("__bucket", bucket).join(full, "__bucket", "left_semi").groupBy(*keys).agg(F.count("*").alias("__rows"))
    found = cut(counted.where(F.col("__rows") > most))
    return None if found.isEmpty() else found


def hot_keys(df: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """The keys with more than ``most`` rows, or null where there are none."""
    found = hot_counts(df, keys, most)
    return None if found is None else found.select(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int = TASK_ROWS) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where keys of ``left`` with more than ``most`` rows are parted.

    The rows of such a key are dealt out by a hash of the whole row, and what ``right`` has of
    it is copied to each part; ``right`` should have few rows a key. ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``.
    """
    hot = hot_counts(left.select(*keys), keys, most)
    if hot is None:
        return left.join(right, keys, how)
    parts = hot.select(*keys, F.ceil(F.col("__rows") / most).cast("int").alias("__parts"))
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    dealt = left.join(parts, keys, "left").withColumn("__part", F.when(some, F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__parts")), F.lit(0)).cast("int")).otherwise(F.lit(0))).drop("__parts")
    copied = right.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")
