"""Retrieval lanes, deduplication, rank fusion and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.vectors import exact_knn  # noqa: F401 - the dense lane

#: Lanes in their order, and the constant of reciprocal rank fusion.
LANES = ("dense", "lexical", "facts", "tables")
RRF_K = 60
FUSED_WINDOW = 100


def lane_filter(items: DataFrame, as_of: Column, kinds: list[str] | None = None, entities: list[str] | None = None, documents: list[str] | None = None, forms: list[str] | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """What a lane may see: published by the cutoff, and within each list that is given.

    None means no filter; an empty list matches nothing. ``corpus`` (document_version_id) is a
    membership table.
    """
    out = items.where(F.col("published_at") <= as_of)
    for column, values in (("kind", kinds), ("entity_id", entities), ("document_id", documents), ("form", forms)):
        if values is not None:
            out = out.where(F.col(column).isin(values) if values else F.lit(False))
    return out if corpus is None else out.join(corpus.select("document_version_id"), "document_version_id", "left_semi")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double; 1 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norm)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_scores(items: DataFrame, id_col: str, text: str, terms: list[str]) -> DataFrame:
    """(item_id, score): items that hold every term, by how densely they hold them.

    The score is the number of hits per square root of the word count. Nothing is
    shuffled: words are counted within each row.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    w = items.select(F.col(id_col).alias("item_id"), F.lower(F.col(text)).alias("__t"))
    for t in terms:  # a text without the letters of a term is dropped before it is cut into words
        w = w.where(F.col("__t").contains(t))
    w = w.select("item_id", F.explode(F.array(words(F.col("__t")))).alias("__w"))  # cut once, not in every test
    for t in terms:
        w = w.where(F.array_contains("__w", t))
    hits = F.size(F.filter("__w", lambda x: x.isin(terms)))
    return w.select("item_id", F.round(hits / F.sqrt(F.size("__w")), 6).alias("score"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """Adds 1-based ranks in a total order within ``keys``; with ``most``, only the first so many."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if most is None else out.where(F.col(name) <= most)


def provenance_key(kind: Column, fact: Column, version: Column, row_index: Column, span: Column) -> Column:
    """What a candidate shows: a fact, a row of a table, or a span of text."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.when(fact.isNotNull(), F.concat_ws("|", F.lit("fact"), part(fact))).when(row_index.isNotNull(), F.concat_ws("|", F.lit("row"), part(version), part(span), part(row_index))).otherwise(F.concat_ws("|", F.lit("span"), part(kind), part(span)))


def anchor_text(fact: Column, span: Column, row_index: Column) -> Column:
    """Where a candidate points, as a text: a fact, a row of a table, else a span."""
    some = F.coalesce(span, F.lit(""))
    row = F.concat(F.lit("row:"), some, F.lit("#"), row_index.cast("string"))
    return F.when(fact.isNotNull(), F.concat(F.lit("fact:"), fact)).when(row_index.isNotNull(), row).otherwise(F.concat(F.lit("span:"), some))


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    """1 / (k + rank), rounded half even to 12 places, as an exact decimal."""
    return F.bround(F.lit(1).cast("decimal(38,18)") / (F.lit(k) + rank).cast("decimal(10,0)"), 12).cast("decimal(13,12)")


def fuse(candidates: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Reciprocal rank fusion: (fused, decisions).

    Candidates have run, item_id, lane, lane_rank and a ``provenance`` key. Items of one
    provenance are merged first: the one with the best lane rank, then the smallest id,
    survives with its own lane appearances only. Fused rows are (run, item_id, fused_score,
    fused_rank), decisions (run, item_id, kept, merged_into). Repeated appearances of an item in
    a lane count once, by the best rank.
    """
    seen = candidates.groupBy(run, "item_id", "lane").agg(F.min("lane_rank").alias("lane_rank"), F.min("provenance").alias("provenance"))
    item = seen.groupBy(run, "item_id").agg(F.min("lane_rank").alias("best"), F.min("provenance").alias("provenance"), F.sum(rrf_term(F.col("lane_rank"))).cast("decimal(16,12)").alias("fused_score"))
    group = Window.partitionBy(run, "provenance").orderBy("best", "item_id")
    decided = item.withColumns({"__n": F.row_number().over(group), "__first": F.first("item_id").over(group)})
    kept = decided.where("__n = 1")
    fused = ranked(kept.select(run, "item_id", "fused_score"), [run], [F.col("fused_score").desc(), F.col("item_id")], "fused_rank")
    decisions = decided.select(run, "item_id", (F.col("__n") == 1).alias("kept"), F.when(F.col("__n") > 1, F.col("__first")).alias("merged_into"))
    return fused, decisions


def rerank(fused: DataFrame, reranker: Callable[[DataFrame], DataFrame] | None = None, window: int = FUSED_WINDOW, top_k: int = FUSED_WINDOW) -> DataFrame:
    """The first ``window`` fused rows, passed through ``reranker`` (which may reorder, not renumber), then cut to ``top_k``."""
    head = fused.where(F.col("fused_rank") <= window)
    head = reranker(head) if reranker else head
    return head.where(F.col("fused_rank") <= top_k)


def context(fused: DataFrame, budget: int) -> DataFrame:
    """Adds ``decision``: accepted up to the budget, else beyond_context_budget."""
    return fused.withColumn("decision", F.when(F.col("fused_rank") <= budget, "accepted").otherwise("beyond_context_budget"))


def recall(found: Column, gold: Column, k: int) -> Column:
    """Share of ``gold`` among the first k of ``found``; 1 where there is no gold."""
    return F.when(F.size(gold) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), gold)) / F.size(F.array_distinct(gold)))
