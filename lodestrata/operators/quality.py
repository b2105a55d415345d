"""Violations, corpus metrics, gates and spend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.history import ranged, running_sum
from lodestrata.operators.hot import TASK_ROWS, hot_keys


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(check, key): rows that break a condition. A condition that is null isn't broken."""
    found = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("check"))


def not_unique(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys with more than one row (of those in ``where``: a partial unique index)."""
    return (rows if where is None else rows.where(where)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, columns: list[str], parents: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows whose (fully non-null) composite key no parent has."""
    p = parents.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(parent_columns)]).distinct()
    on = reduce(lambda a, b: a & b, [rows[c] == p[f"__{i}"] for i, c in enumerate(columns)])
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).join(p, on, "left_anti")


def one_kind_anchor(kind: Column, anchors: dict[str, Column]) -> Column:
    """Exactly the anchor of the row's kind is set."""
    ok = F.lit(False)
    for k, c in anchors.items():
        others = reduce(lambda a, b: a & b, [o.isNull() for n, o in anchors.items() if n != k], F.lit(True))
        ok = ok | ((kind == k) & c.isNotNull() & others)
    return ok


def fact_counts(facts: DataFrame, by: list[str]) -> DataFrame:
    """Total, canonical, duplicate and restated facts."""
    return facts.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count_if(F.col("duplicate_of").isNull()).alias("n_canonical"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("n_duplicate"), F.count_if(F.col("restates").isNotNull()).alias("n_restated"),
    )


def rate_text(part: Column, whole: Column) -> Column:
    """A share to 6 places, or ``unavailable`` where there is nothing to count."""
    return F.when(whole == 0, F.lit("unavailable")).otherwise(F.format_string("%.6f", part / whole))


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): missing (expected only) and surplus (actual only) keys."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("surplus")))


def ratio_or_one(part: Column, whole: Column) -> Column:
    """A gate's ratio; 1 with nothing to count (the gate then fails for want of support)."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, support, threshold, passed): at least the threshold, with support."""
    return metrics.join(thresholds, "metric").withColumn("passed", (F.col("value") >= F.col("threshold")) & (F.col("support") > 0))


def spend(usage: DataFrame, now: Column, user: str, amount: str, at: str) -> DataFrame:
    """(user, day_spend, month_spend) in the day and month of ``now``."""
    within = lambda unit: F.date_trunc(unit, F.col(at)) == F.date_trunc(unit, now)
    total = lambda unit: F.round(F.coalesce(F.sum(F.when(within(unit), F.col(amount))), F.lit(0.0)), 4)
    return usage.groupBy(user).agg(total("day").alias("day_spend"), total("month").alias("month_spend"))


def ceiling(day: Column, month: Column, soft_day: float, hard_day: float, soft_month: float, hard_month: float) -> Column:
    """block at a hard limit, warn at a soft one, else ok."""
    return F.when((day >= hard_day) | (month >= hard_month), "block").when((day >= soft_day) | (month >= soft_month), "warn").otherwise("ok")


def pin_codes(rows: DataFrame, known: DataFrame, key: str, pin: str) -> DataFrame:
    """Adds ``code``: UNKNOWN_SPAN where no row of ``known`` has the key, WRONG_VERSION where none has it with the row's pin, else ok."""
    keys = known.select(key).distinct().withColumn("__key", F.lit(True))
    pairs = known.select(key, pin).distinct().withColumn("__pair", F.lit(True))
    joined = rows.join(keys, key, "left").join(pairs, [key, pin], "left")
    return joined.withColumn("code", F.when(F.col("__key").isNull(), "UNKNOWN_SPAN").when(F.col("__pair").isNull(), "WRONG_VERSION").otherwise("ok")).drop("__key", "__pair")


def differing(fields: dict[str, tuple[str, str]]) -> Column:
    """Names of the fields whose two columns differ (null-safe), in order."""
    return F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(n)) for n, (a, b) in fields.items()]))


def job_counts(jobs: DataFrame, by: list[str], status: str, done: list[str], failed: list[str]) -> DataFrame:
    """(by, n_total, n_succeeded, n_pending, n_failed); what is neither done nor failed, null too, is pending."""
    is_done, is_failed = F.coalesce(F.col(status).isin(*done), F.lit(False)), F.coalesce(F.col(status).isin(*failed), F.lit(False))
    return jobs.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(is_done).alias("n_succeeded"), F.count_if(~is_done & ~is_failed).alias("n_pending"), F.count_if(is_failed).alias("n_failed"))


def visible_to(rows: DataFrame, claim: DataFrame, owner: str) -> DataFrame:
    """Rows of the one owner in ``claim`` (claim) and of nobody; without a claim, only those of nobody."""
    one = claim.first()
    own = F.col(owner) == one["claim"] if one is not None else F.lit(False)
    return rows.where(F.col(owner).isNull() | own)


def first_writes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(order, outcome): the first row under a key is accepted, later ones are a replay (same value) or a conflict.

    ``order`` is unique. The first write comes from an aggregation that combines before the shuffle.
    """
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("__first"))
    same = F.lit(True)
    on = [rows[k].eqNullSafe(first[k]) for k in keys]
    for c in on:
        same = same & c
    joined = rows.join(first, same)
    outcome = F.when(rows[order] == F.col("__first.o"), "accepted").when(rows[value].eqNullSafe(F.col("__first.v")), "replay").otherwise("conflict")
    return joined.select(rows[order], outcome.alias("outcome"))


def exact_quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, name): the smallest value that at least ``share`` of a key's values don't exceed, exactly.

    Approximate quantiles, whose rank error is at most 1 / ``accuracy``, bracket it; values below the bracket are only
    counted, those within it are counted per value, before any shuffle, and summed in order. So of a key of any size
    few rows meet in one task. Nulls don't count; a key without values has no row.
    """
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    at = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
    bracket = v.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.percentile_approx("__v", at, accuracy).alias("__q"), F.count("*").alias("__n"))
    same = F.lit(True)
    for k in keys:
        same = same & v[k].eqNullSafe(bracket[f"__{k}"])
    inside = (F.col("__v") >= F.col("__q")[0]) & (F.col("__v") <= F.col("__q")[1])
    met = v.join(bracket, same).where(F.col("__v") <= F.col("__q")[1])
    counted = met.groupBy(*keys, "__n", F.when(inside, F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("__sum", F.sum("__c").over(w)).where(F.col("__v").isNotNull() & (F.col("__sum") >= F.col("__n") * share))
    return summed.groupBy(*keys).agg(F.min("__v").alias(name))


def budget(charges: DataFrame, user: str, order: str, amount: str, limit: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds ``spent`` (what the user spent up to and with a charge, to 4 places) and ``verdict``: allowed, or blocked once the limit is passed.

    ``order`` is unique; users with very many charges are summed range by range.
    """
    hot = hot_keys(charges, [user], task_rows)
    summed = running_sum(ranged(charges, [user], [order], hot, task_rows), [user], [order], hot, amount, "spent").drop("__range")
    return summed.withColumn("spent", F.round("spent", 4)).withColumn("verdict", F.when(F.col("spent") > limit, "blocked").otherwise("allowed"))
