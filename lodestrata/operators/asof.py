"""Attributes as known at event time.

Each attribute of a versioned entity gets its own change history, free of the versions in
which it didn't change; an event is matched with the last known point of each history by
itself, and the matches are pivoted back into one row per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.history import ranged
from lodestrata.operators.hot import TASK_ROWS, hot_keys, spread_join
from lodestrata.operators.stab import around, cover

#: Versions of one key up to which its histories travel as arrays; longer ones are rows, cut into ranges. Only the plan differs.
ARRAY_VERSIONS = 64
#: Times are numbered in microseconds within 2^60 around 1970, which holds every timestamp.
LEVELS = 60


def _tick(c: Column) -> Column:
    return F.unix_micros(c) + F.lit(1 << (LEVELS - 1))


def change_histories(versions: DataFrame, key: str, start: str, end: str, rank: list[str], attributes: list[str]) -> DataFrame:
    """(key, attribute, history): for each attribute the times at which its value changes.

    ``history`` is an array of (since, value) in time order. At any time the version that
    counts is, of those with start <= t < end (null end: open), the one greatest in
    ``rank``; a gap between versions is a point with ``known`` false. Versions with a null
    key, start or first rank never count. The versions of a key must fit an array
    (:data:`ARRAY_VERSIONS`). Values are text.
    """
    facts = F.struct(F.col(start).alias("__start"), F.col(end).alias("__end"), F.struct(*rank).alias("__rank"), *[F.col(a).cast("string").alias(a) for a in attributes])
    grouped = versions.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(rank[0]).isNotNull()).groupBy(key).agg(F.collect_set(facts).alias("__v"))
    ends = F.filter(F.transform("__v", lambda v: v["__end"]), lambda t: t.isNotNull())
    points = F.array_sort(F.array_distinct(F.concat(F.transform("__v", lambda v: v["__start"]), ends)))
    ranked = lambda v: F.struct(v["__rank"], *[v[a].alias(a) for a in attributes])

    def at(t: Column) -> Column:
        alive = F.filter("__v", lambda v: (v["__start"] <= t) & (v["__end"].isNull() | (t < v["__end"])))
        return F.struct(t.alias("since"), F.array_max(F.transform(alive, ranked)).alias("won"))

    timeline = grouped.select(key, F.transform(points, at).alias("__line"))
    def history_of(a: str) -> Column:
        line = F.transform("__line", lambda p: F.struct(p["since"].alias("since"), p["won"].isNotNull().alias("known"), p["won"][a].alias("value")))

        def marked(p: Column, i: Column) -> Column:
            before = F.get(line, i - 1)
            return F.struct(p.alias("p"), ((i > 0) & (before["known"] == p["known"]) & before["value"].eqNullSafe(p["value"])).alias("same"))

        changed = F.filter(F.transform(line, marked), lambda x: ~x["same"])
        return F.struct(F.lit(a).alias("attribute"), F.transform(changed, lambda x: x["p"]).alias("history"))

    long = [history_of(a) for a in attributes]
    return timeline.select(key, F.explode(F.array(*long)).alias("h")).select(key, "h.attribute", "h.history")


def _long_histories(versions: DataFrame, key: str, start: str, end: str, rank: list[str], attributes: list[str], task_rows: int) -> DataFrame:
    """(key, attribute, since, known, value): the same histories as rows, for keys with any number of versions.

    The validity of a version is cut into at most 2 x LEVELS aligned intervals, of which each
    keeps its best version, by an aggregation that combines before the shuffle. A point in time at which a
    version starts or ends looks up the LEVELS + 1 intervals it lies in; no key is gathered in one task.
    """
    able = versions.where(F.col(start).isNotNull() & F.col(rank[0]).isNotNull())
    nodes = cover(_tick(F.col(start)), F.coalesce(_tick(F.col(end)), F.lit(1 << LEVELS)), LEVELS)
    value = F.struct(F.struct(*rank).alias("__rank"), *[F.col(a).cast("string").alias(a) for a in attributes])
    best = (
        able.where(F.col(end).isNull() | (F.col(start) < F.col(end)))
        .select(key, value.alias("won"), F.explode(nodes).alias("__n")).groupBy(key, "__n").agg(F.max("won").alias("won"))
    )
    points = able.select(key, F.explode(F.array_compact(F.array(start, end))).alias("since")).distinct()
    asked = points.select(key, "since", F.explode(around(_tick(F.col("since")), LEVELS)).alias("__n"))
    won = spread_join(asked, best, [key, "__n"], "left", task_rows).groupBy(key, "since").agg(F.max("won").alias("won"))
    each = [F.struct(F.lit(a).alias("attribute"), F.col("won").isNotNull().alias("known"), F.col(f"won.{a}").alias("value")) for a in attributes]
    return won.select(key, "since", F.explode(F.array(*each)).alias("h")).select(key, "h.attribute", "since", "h.known", "h.value")


def _last_points(events: DataFrame, ids: list[str], histories: DataFrame, key: str, at: str, attributes: list[str], task_rows: int) -> DataFrame:
    """(ids, attribute, known, value): the last point of each attribute's history at or before each event.

    Points and events of a key and attribute are sorted together, range by range; the last point
    of each range is carried into the next ones, over one row per range.
    """
    order = ["__t", "__event"]
    group = [key, "attribute"]
    asked = events.select(F.struct(*ids).alias("__id"), F.col(key), F.col(at).alias("__t"), F.explode(F.array(*[F.lit(a) for a in attributes])).alias("attribute"))
    point = F.struct("known", "value")
    both = histories.select(key, "attribute", F.col("since").alias("__t"), F.lit(0).alias("__event"), point.alias("__p")).unionByName(asked.withColumn("__event", F.lit(1)), allowMissingColumns=True)
    hot = hot_keys(both, group, task_rows)
    both = ranged(both, group, order, hot, task_rows)
    w = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__p", ignorenulls=True).over(w))
    if hot is not None:
        ends = both.where("__range is not null").groupBy(*group, "__range").agg(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.col("__t"))).alias("__end"))
        carried = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*group, "__range", F.last("__end", ignorenulls=True).over(carried).alias("__before"))
        out = out.join(ends, [*group, "__range"], "left").withColumn("__last", F.coalesce("__last", "__before"))
    return out.where("__event = 1").select("__id.*", "attribute", "__last.known", "__last.value")


def asof_attributes(
    events: DataFrame, versions: DataFrame, key: str, at: str, start: str, end: str, rank: list[str], attributes: list[str], array_versions: int = ARRAY_VERSIONS, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``events`` with the ``attributes`` known at the time ``at``, one row per event matched.

    ``events`` holds ``key``, ``at`` and the columns that identify an event (their names must
    not clash with the attributes). Of the versions of the same key with start <= at < end
    (null end: open) the greatest in ``rank`` counts; ``start`` should be the later of all the
    times from which a version may be known, so that nothing from later leaks in. Attributes
    come out as text, null where the version that counts has a null.

    Events without a version, with a null key or time, give no row; repeated events give one
    row; empty inputs an empty result. Columns of ``versions`` that aren't named play no part.
    The histories of keys with up to ``array_versions`` versions travel as arrays, those of others as rows in time
    order; events and points of a key beyond ``task_rows`` are parted over tasks. The result is the same.
    """
    ids = events.columns
    events = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    # an attribute may bear the name of an event's column: attributes travel under own names
    inner = {a: f"__a{i}" for i, a in enumerate(attributes)}
    versions = versions.select(F.col(key).alias("__key"), F.col(start).alias("__from"), F.col(end).alias("__to"), *[F.col(r).alias(f"__r{i}") for i, r in enumerate(rank)], *[F.col(a).cast("string").alias(n) for a, n in inner.items()])
    versions = versions.where(F.col("__key").isNotNull())
    ranks, names = [f"__r{i}" for i in range(len(rank))], list(inner.values())
    hot = hot_keys(versions, ["__key"], array_versions)
    pivot = [F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(n) for n in names]
    parts = []
    if hot is not None:
        mine = events.join(hot.withColumnRenamed("__key", key), key, "left_semi").withColumn("__key", F.col(key)).withColumn("__at", F.col(at))
        histories = _long_histories(versions.join(hot, "__key", "left_semi"), "__key", "__from", "__to", ranks, names, task_rows)
        found = _last_points(mine, ids, histories, "__key", "__at", names, task_rows)
        parts.append(found.where("known").groupBy(*ids).agg(*pivot).select(*ids, *names))
        versions = versions.join(hot, "__key", "left_anti")
    histories = change_histories(versions, "__key", "__from", "__to", ranks, names)
    last = F.element_at(F.filter("history", lambda p: p["since"] <= F.col(at)), -1)
    matched = (
        spread_join(events.withColumn("__key", F.col(key)), histories, ["__key"], most=task_rows)
        .where(F.exists("history", lambda p: p["since"] <= F.col(at))).select(*ids, "attribute", last.alias("__p")).where("__p.known")
        .select(*ids, "attribute", F.col("__p.value").alias("value")).groupBy(*ids).agg(*pivot)
    )
    parts.append(matched.select(*ids, *names))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*ids, *[F.col(n).alias(a) for a, n in inner.items()])


def iso_instant(c: Column) -> Column:
    """An ISO 8601 text as a UTC timestamp: a bare date means 00:00, a missing zone UTC."""
    t = F.upper(F.trim(c))
    t = F.regexp_replace(F.regexp_replace(t, r"([0-9]),([0-9])", "$1.$2"), r"(:[0-9]{2}(?:\.[0-9]+)?)\s*([-+][0-9]{2}):?([0-9]{2})$", "$1$2:$3")
    t = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"[0-9]$") & ~t.rlike(r"[-+][0-9]{2}:?[0-9]{2}$"), F.concat(t, F.lit("Z"))).otherwise(t)
    return t.try_cast("timestamp")
