"""References to records that don't exist, come later or were deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import HEX32
from lodestrata.operators.hot import spread_join

#: Parent keys are compared as 128-bit numbers; aligned ranges of 16^3 neighbours stay together.
TAIL = 3


def reference_states(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """For each distinct reference its state: (key, found, written, gone, t_min, t_max).

    ``refs`` has (key, t), ``parents`` (key, written, gone); keys come from
    ``uuid_key``. Parent keys, sorted as integers, are compressed into contiguous runs whose
    rows were written and deleted alike; each reference is matched with the run that starts
    at or before it, and doesn't exist if it lies beyond that run's end. Both sides are
    gathered by aligned key ranges of 4,096 integers, so a group is bounded whatever the
    keys; hot references are combined before the shuffle. Keys that aren't hexadecimal are
    ranges of their own. Of repeated parents the earliest writing and the latest deletion
    (null: not deleted) count.
    """
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    p = parents.where(F.col("key").isNotNull()).select("key", F.lit(True).alias("is"), "written", F.coalesce("gone", never).alias("gone"), F.lit(None).cast("timestamp").alias("t"))
    r = refs.where(F.col("key").isNotNull()).select("key", F.lit(None).cast("boolean").alias("is"), F.lit(None).cast("timestamp").alias("written"), F.lit(None).cast("timestamp").alias("gone"), "t")
    number = F.col("key").rlike(HEX32)
    both = p.unionByName(r).withColumns({
        "range": F.when(number, F.left("key", F.lit(32 - TAIL))).otherwise(F.concat(F.lit("text:"), F.col("key"))),
        "at": F.when(number, F.conv(F.right("key", F.lit(TAIL)), 16, 10).cast("int")).otherwise(F.lit(0)),
    })
    each = both.groupBy("range", "at").agg(
        F.max("is").alias("is"), F.min("written").alias("written"), F.max("gone").alias("gone"),
        F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.max(F.when(F.col("is").isNull(), F.lit(True))).alias("asked"), F.first("key").alias("key"),
    )
    w = Window.partitionBy("range").orderBy("at")
    parent = F.when(F.col("is"), F.struct("at", "written", "gone"))
    before = F.last(parent, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("before", before)
    start = F.col("is") & (F.col("before").isNull() | (F.col("before.at") + 1 != F.col("at")) | ~F.col("before.written").eqNullSafe(F.col("written")) | (F.col("before.gone") != F.col("gone")))
    runs = each.withColumn("run", F.sum(F.coalesce(start.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("range", "run")
    runs = runs.withColumns({"end": F.max(F.when(F.col("is"), F.col("at"))).over(of_run), "run_of": F.first(parent, ignorenulls=True).over(of_run)})
    found = F.coalesce((F.col("run") > 0) & (F.col("at") <= F.col("end")), F.lit(False))
    return runs.where("asked").select(
        "key", found.alias("found"), F.when(found, F.col("run_of.written")).alias("written"),
        F.when(found & (F.col("run_of.gone") < never), F.col("run_of.gone")).alias("gone"), "t_min", "t_max",
    )


def broken_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references that lead to no row as of their time: (row_id, key, t, kind).

    ``refs`` has (row_id, key, t). ``missing``: no parent has the key; ``late``: it was
    written after t; ``deleted``: it was gone at t. Null keys are no references. A null t is
    earlier and later than nothing, so only ``missing`` can hold. Rows come out once each.
    """
    states = reference_states(refs.select("key", "t"), parents)
    suspects = states.where(~F.col("found") | (F.col("written") > F.col("t_min")) | (F.col("gone") <= F.col("t_max"))).select("key", "found", "written", "gone")
    kind = F.when(~F.col("found"), "missing").when(F.col("written") > F.col("t"), "late").when(F.col("gone") <= F.col("t"), "deleted")
    return spread_join(refs, suspects, ["key"]).select("row_id", "key", "t", kind.alias("kind")).where(F.col("kind").isNotNull()).distinct()


def reference_report(broken: DataFrame) -> DataFrame:
    """Broken references per table, field, month and kind."""
    return broken.groupBy("table_name", "field_name", "ref_month", "kind").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_ids"))
