"""Claims against the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.retrieval import words

NUMERIC_PARTS = ("value", "unit", "period", "sign", "scale")


def token_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def shared(claim: Column, source: Column) -> Column:
    """Share of the claim's words (a set) among the source's; 0 for a claim without words."""
    return F.when(F.size(claim) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(claim, source)) / F.size(claim))


def coverage(claim: Column, source: Column) -> Column:
    """Share of the claim's distinct words that the source has."""
    return shared(token_set(claim), token_set(source))


def failed_parts(claim: Column, fact: Column) -> Column:
    """Names of the numeric parts in which two structs differ (null-safe)."""
    return F.array_compact(F.array(*[F.when(~claim[p].eqNullSafe(fact[p]), F.lit(p)) for p in NUMERIC_PARTS]))


def edge_kind(share: Column, failed: Column | None = None, entailed: float = 1.0, partial: float = 0.5) -> Column:
    """contradictory (a numeric part differs), entailed, partial or irrelevant."""
    rest = F.when(share >= entailed, "entailed").when(share >= partial, "partial").otherwise("irrelevant")
    return rest if failed is None else F.when(failed, "contradictory").otherwise(rest)


def fold_claims(edges: DataFrame, claim: str = "claim_id", kind: str = "edge") -> DataFrame:
    """(claim, status): a contradiction wins, then entailment, then partial support."""
    has = lambda k: F.coalesce(F.bool_or(F.col(kind) == k), F.lit(False))
    status = F.when(has("contradictory"), "contradicted").when(has("entailed"), "supported").when(has("partial"), "partially_supported").otherwise("unsupported")
    return edges.groupBy(claim).agg(status.alias("status"))


def claims_of(text: Column) -> Column:
    """The sentences of a text, each a claim as it stands; blank ones are none."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def word_support(claims: DataFrame, items: DataFrame, scope: str, partial: float = 0.5) -> DataFrame:
    """(claim_id, share): the greatest share of each claim's words that one item of its scope has, where it is at least ``partial``.

    Claims have (claim_id, scope, words), items (scope, words); words are sets. An item with that share of a claim
    must have one of the claim's rarest words: all but as many as would still miss the share. So these are looked up in an
    index of the items' words, and only pairs that meet there are compared. Claims of the same words are compared once.
    A claim without words has no share, nor one that no item supports so far.
    """
    said = claims.select(scope, "words").where(F.size("words") > 0).distinct().withColumn("__said", F.xxhash64(scope, "words"))
    known = items.select(scope, F.col("words").alias("__has")).distinct().withColumn("__item", F.xxhash64(scope, "__has"))
    index = known.select(scope, "__item", F.explode("__has").alias("word"))
    rarity = index.groupBy(scope, "word").agg(F.count("*").alias("__n"))
    each = said.select(scope, "__said", F.explode("words").alias("word"), (F.size("words") - F.ceil(F.size("words") * partial) + 1).alias("__least"))
    ordered = each.join(rarity, [scope, "word"], "left").withColumn("__k", F.row_number().over(Window.partitionBy(scope, "__said").orderBy(F.coalesce("__n", F.lit(0)), "word")))
    pairs = ordered.where(F.col("__k") <= F.col("__least")).join(index, [scope, "word"]).select(scope, "__said", "__item").distinct()
    best = pairs.join(said, [scope, "__said"]).join(known, [scope, "__item"]).groupBy(scope, "words").agg(F.max(shared(F.col("words"), F.col("__has"))).alias("share"))
    return claims.join(best.where(F.col("share") >= partial), [scope, "words"]).select("claim_id", "share")


def abstains(claims: DataFrame, run: str) -> DataFrame:
    """(run, abstained): no claim of the run is supported at all; runs come with at least one row (null status: no claim)."""
    return claims.groupBy(run).agg(F.coalesce(F.bool_and(F.col("status") == "unsupported"), F.lit(True)).alias("abstained"))


def citation_codes(citations: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds ``code``: DANGLING_CITATION, CROSS_VERSION_CITATION or null.

    Citations have (run_id, item_id, source_span_id), accepted the same for accepted items.
    """
    a = accepted.groupBy("run_id", "item_id").agg(F.min("source_span_id").alias("__span"), F.lit(True).alias("__is"))
    joined = citations.join(a, ["run_id", "item_id"], "left")
    code = F.when(F.col("__is").isNull(), "DANGLING_CITATION").when(~F.col("__span").eqNullSafe(F.col("source_span_id")), "CROSS_VERSION_CITATION")
    return joined.withColumn("code", code).drop("__span", "__is")
