"""Point-in-time visibility, priors, siblings and amendments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.history import neighbours, ranged, running_sum
from lodestrata.operators.hot import TASK_ROWS, hot_keys
from lodestrata.plans.tables import cut


def known_by(rows: DataFrame, as_of: Column, published: str = "published_at") -> DataFrame:
    """Rows published at or before ``as_of``; a null date is never known."""
    return rows.where(F.col(published) <= as_of)


def vintage_day(cutoff: Column) -> Column:
    """The last day whose vintages are known at ``cutoff``: the UTC day before it."""
    return F.date_sub(F.to_date(cutoff), 1)


def with_status(documents: DataFrame, versions: DataFrame, status: str = "parsed") -> DataFrame:
    """Documents that have a version in ``status`` (documents.id = versions.document_id)."""
    return documents.join(versions.where(F.col("status") == status).select(F.col("document_id").alias("id")), "id", "left_semi")


def first_in(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total for a stable result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_versions(versions: DataFrame, status: str = "parsed") -> DataFrame:
    """The newest version in ``status`` of each document; ties go to the smallest id."""
    return first_in(versions.where(F.col("status") == status), ["document_id"], [F.col("created_at").desc(), F.col("id")])


def prior_facts(facts: DataFrame, cutoff: Column, excluded_form: str = "COMPANYFACTS") -> DataFrame:
    """The last canonical fact of each fact_key published strictly before ``cutoff``.

    Facts need fact_key, duplicate_of, form, published_at, created_at, id. Duplicates don't
    count, nor facts of ``excluded_form``; a null form does.
    """
    able = facts.where(F.col("duplicate_of").isNull() & F.col("fact_key").isNotNull() & ~F.col("form").eqNullSafe(F.lit(excluded_form)) & (F.col("published_at") < cutoff))
    return first_in(able, ["fact_key"], [F.col("published_at").desc(), F.col("created_at").desc(), F.col("id")])


def siblings(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, published_at): other documents of the target's entity not published after it."""
    t = targets.select(F.col("id").alias("target"), "entity_id", F.col("published_at").alias("__at"))
    return documents.join(t, "entity_id").where((F.col("id") != F.col("target")) & (F.col("published_at") <= F.col("__at"))).select("target", "id", "published_at")


def sibling_summary(documents: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(target, n_siblings, latest, latest_at): how many other documents of its entity were published by then, and the latest of them.

    Documents have (id, entity_id, published_at). Points in time are counted first and then summed along each entity,
    range by range where it has very many; of each point and the one before the two greatest ids suffice. So no pairs are made.
    Documents without entity or date have no row; ties go to the greater id.
    """
    d = documents.where(F.col("entity_id").isNotNull() & F.col("published_at").isNotNull()).select("id", "entity_id", "published_at").distinct()
    points = cut(d.groupBy("entity_id", "published_at").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    hot = hot_keys(points, ["entity_id"], task_rows)
    parted = ranged(points, ["entity_id"], ["published_at"], hot, task_rows)
    summed = running_sum(parted, ["entity_id"], ["published_at"], hot, "n", "upto")
    summed = neighbours(summed, ["entity_id"], ["published_at"], hot, before={"earlier": "top", "earlier_at": "published_at"})
    second = d.join(points.select("entity_id", "published_at", "top"), ["entity_id", "published_at"]).where("id <> top").groupBy("entity_id", "published_at").agg(F.max("id").alias("second"))
    at = summed.join(second, ["entity_id", "published_at"], "left").select("entity_id", "published_at", "upto", "top", "second", "earlier", "earlier_at")
    beside = F.when(F.col("id") != F.col("top"), F.col("top")).otherwise(F.col("second"))
    return d.join(at, ["entity_id", "published_at"]).select(
        F.col("id").alias("target"), (F.col("upto") - 1).alias("n_siblings"), F.coalesce(beside, "earlier").alias("latest"), F.when(beside.isNotNull(), F.col("published_at")).otherwise(F.col("earlier_at")).alias("latest_at")
    )


def pinned(documents: DataFrame, versions: DataFrame, id_col: str) -> DataFrame:
    """(id, n, version_id, code): the one version of each document; NO_VERSION or MANY_VERSIONS otherwise.

    Documents have (id, document_id), versions (id, document_id).
    """
    v = versions.groupBy("document_id").agg(F.count("*").alias("n"), F.min("id").alias("version_id"))
    joined = documents.join(v, "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("n") == 0, "NO_VERSION").when(F.col("n") > 1, "MANY_VERSIONS")
    return joined.select(id_col, "n", F.when(F.col("n") == 1, F.col("version_id")).alias("version_id"), code.alias("code"))


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "/A$", "")


def amendment_links(documents: DataFrame) -> DataFrame:
    """(id, amends): the document each amendment (form ending in /A) amends.

    Candidates share entity, base form and the full period (a null never matches): an original published
    no later, or another amendment published strictly earlier. The latest wins, then the
    greater id. Within a period an entity's filings are few, so the ordering is one window over
    filings, not a join of pairs: the last predecessor in time is carried forward.
    """
    keys = ["entity_id", "base", "period_start", "period_end"]
    d = documents.where(F.col("form").isNotNull() & F.col("period_start").isNotNull() & F.col("period_end").isNotNull() & F.col("published_at").isNotNull())
    d = d.select("id", "entity_id", base_form(F.col("form")).alias("base"), "period_start", "period_end", "published_at", F.col("form").endswith("/A").alias("amended"))
    cell = F.struct("published_at", "id")
    by_time = Window.partitionBy(*keys).orderBy(F.unix_micros("published_at"))
    original = F.max(F.when(~F.col("amended"), cell)).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
    earlier = F.max(F.when(F.col("amended"), cell)).over(by_time.rangeBetween(Window.unboundedPreceding, -1))
    return d.withColumn("best", F.greatest(original, earlier)).where("amended and best is not null").select("id", F.col("best.id").alias("amends"))


def chain_ends(links: DataFrame) -> DataFrame:
    """(id, terminal, steps): where following ``amends`` from each document ends.

    Links point back in time, so chains end; doubling takes log2 of the longest one.
    """
    state = cut(links.select("id", F.col("amends").alias("terminal"), F.lit(1).alias("steps")))
    while True:
        onward = state.select(F.col("id").alias("terminal"), F.col("terminal").alias("next"), F.col("steps").alias("more"))
        moved = state.join(onward, "terminal", "left")
        if moved.where("next is not null").isEmpty():
            return state
        state = cut(moved.select("id", F.coalesce("next", "terminal").alias("terminal"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), drop=state)
