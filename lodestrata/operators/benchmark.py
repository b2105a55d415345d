"""Compiling benchmarks: quotes resolved to spans, temporal leakage, metrics over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import accession_key
from lodestrata.plans.tables import cut

#: Bytes of quotes that are broadcast at once.
BLOCK_BYTES = 8 << 20


def resolve_quotes(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """(quote_id, n, span_id, code): spans of the quote's accession and section that contain it.

    One is resolved; none is UNRESOLVED_QUOTE, several AMBIGUOUS_QUOTE (no span then).
    Quotes have (quote_id, accession, section, quote), spans (accession, section, span_id, text).
    """
    hits = quotes.join(spans, ["accession", "section"]).where(F.col("text").contains(F.col("quote"))).groupBy("quote_id").agg(F.countDistinct("span_id").alias("n"), F.min("span_id").alias("span_id"))
    out = quotes.select("quote_id").distinct().join(hits, "quote_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("n") == 0, "UNRESOLVED_QUOTE").when(F.col("n") > 1, "AMBIGUOUS_QUOTE")
    return out.select("quote_id", "n", F.when(F.col("n") == 1, F.col("span_id")).alias("span_id"), code.alias("code"))


def quote_scopes(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """(quote_id, accession, n, span_id, code): for each accession with a whole quote in its texts, in how many spans it stands.

    Several spans of one accession are AMBIGUOUS_QUOTE (no span then); a quote in no text at all
    has one row, UNRESOLVED_QUOTE. An empty quote is in none. Quotes have (quote_id, quote), spans (accession, span_id, text).

    What stands between two blanks of a quote must stand between blanks in the text. So texts
    are first asked for one such part of each quote, the one in fewest texts of the corpus; the whole
    quote is then compared there. Quotes without such a part are compared with every text, in blocks of BLOCK_BYTES.

    Spark takes texts for a fraction of their size in memory, as files are compressed and columns are weighed by their
    types. So texts, their parts and quotes stand where they can't be broadcast: left of semi-joins, in merge joins or
    beside a block. What may be broadcast is written first.
    """
    asked = cut(quotes.where(F.length("quote") > 0).select("quote_id", "quote").distinct().withColumn("ask", F.monotonically_increasing_id()))
    inner = F.split("quote", " ", -1)
    inner = asked.select("ask", F.explode(F.array_distinct(F.filter(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda x: x != ""))).alias("part"))
    held = spans.select("span_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("part"))
    having = lambda rows, c, some: rows.join(cut(some.select(c).distinct()), c, "left_semi")
    counted = cut(having(held, "part", inner).groupBy("part").agg(F.count("*").alias("__n")))
    rarest = cut(inner.join(counted, "part", "left").groupBy("ask").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "part"))["part"].alias("part")))
    found = cut(having(held, "part", rarest).distinct())
    rare = found.join(rarest, "part").select("span_id", "ask").join(asked.hint("merge"), "ask")
    whole = F.col("text").contains(F.col("quote"))
    hits = having(spans, "span_id", found).hint("merge").join(rare, "span_id").where(whole).select("quote_id", "accession", "span_id")
    rest = cut(asked.join(rarest, "ask", "left_anti"))
    blocks = -(-(rest.agg(F.sum(F.octet_length("quote"))).first()[0] or 0) // BLOCK_BYTES)
    for k in range(blocks):  # one after another, so that the driver holds one
        block = rest.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == k)
        hits = hits.unionByName(cut(spans.join(F.broadcast(block), whole).select("quote_id", "accession", "span_id")))
    scopes = hits.groupBy("quote_id", "accession").agg(F.countDistinct("span_id").alias("n"), F.min("span_id").alias("span_id"))
    out = quotes.select("quote_id").distinct().join(scopes, "quote_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("n") == 0, "UNRESOLVED_QUOTE").when(F.col("n") > 1, "AMBIGUOUS_QUOTE")
    return out.select("quote_id", "accession", "n", F.when(F.col("n") == 1, F.col("span_id")).alias("span_id"), code.alias("code"))


def temporal_codes(accepted: Column, as_of: Column, role: Column) -> Column:
    """Evidence must be accepted by the cutoff; a future revision strictly after it.

    A time of exactly midnight UTC is provisional (a date without its time), so it counts as known
    only from the next day on.
    """
    provisional = F.date_trunc("day", accepted) == accepted
    known = F.when(provisional, accepted + F.expr("INTERVAL 1 DAY") <= as_of).otherwise(accepted <= as_of)
    return F.when(accepted.isNull(), "UNKNOWN_ACCESSION").when((role == "evidence") & ~known, "EVIDENCE_AFTER_CUTOFF").when((role == "future_revision") & (accepted <= as_of), "REVISION_NOT_AFTER_CUTOFF")


def manifest_codes(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(id, codes): what is wrong with each entry, in the order of the codes, between commas.

    NO_EVIDENCE (none reviewed), UNKNOWN_ACCESSION (one that isn't in ``known`` (acc)), DUPLICATE_EVIDENCE (one twice),
    EVIDENCE_IS_REVISION (one that is to come later too). Entries have (id, documents_reviewed, future_revisions);
    accessions compare by their digits.
    """
    named = lambda c: entries.select("id", F.explode(c).alias("a")).select("id", accession_key(F.col("a")).alias("acc")).where("acc is not null")
    each = named("documents_reviewed").groupBy("id", "acc").agg(F.count("*").alias("n"))
    each = each.join(known.withColumn("__known", F.lit(True)), "acc", "left").join(named("future_revisions").distinct().withColumn("__later", F.lit(True)), ["id", "acc"], "left")
    codes = each.groupBy("id").agg(
        F.bool_or(F.col("__known").isNull()).alias("unknown"), F.bool_or(F.col("n") > 1).alias("twice"), F.bool_or(F.col("__later").isNotNull()).alias("later")
    )
    joined = entries.select("id").distinct().join(codes, "id", "left")
    found = [("DUPLICATE_EVIDENCE", F.col("twice")), ("EVIDENCE_IS_REVISION", F.col("later")), ("NO_EVIDENCE", F.col("twice").isNull()), ("UNKNOWN_ACCESSION", F.col("unknown"))]
    return joined.select("id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found])), ",").alias("codes"))


def parsed_ratio(text: Column) -> Column:
    """``a/b`` as a number to 12 places; null where it is none or b is 0."""
    a, b = F.regexp_extract(text, r"^\s*(-?[0-9.]+)\s*/\s*(-?[0-9.]+)\s*$", 1), F.regexp_extract(text, r"^\s*(-?[0-9.]+)\s*/\s*(-?[0-9.]+)\s*$", 2)
    return F.round(F.try_divide(a.try_cast("double"), b.try_cast("double")), 12)


def parsed_range(text: Column) -> Column:
    """``low-high`` as a struct of decimals; null where it is none or they are out of order."""
    p = r"^\s*(-?[0-9.]+)\s*[-–]\s*(-?[0-9.]+)\s*$"
    low, high = F.regexp_extract(text, p, 1).try_cast("decimal(38,10)"), F.regexp_extract(text, p, 2).try_cast("decimal(38,10)")
    return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))


def rank_metrics(ranked: DataFrame, query: str, rank: str, relevant: str, k: int) -> DataFrame:
    """(query, mrr, precision, ndcg) at k for binary relevance; 0 where nothing relevant is found."""
    r, at = F.col(relevant).cast("double"), F.col(rank) <= k
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("__n")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    g = ranked.groupBy(query).agg(
        F.coalesce(F.max(F.when(at & F.col(relevant), 1.0 / F.col(rank))), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(F.when(at, r)) / k, F.lit(0.0)).alias("precision"),
        F.coalesce(F.sum(F.when(at, r / F.log2(F.col(rank) + 1.0))), F.lit(0.0)).alias("__dcg"), F.sum(r).cast("int").alias("__n"),
    )
    return g.select(query, F.round("mrr", 6).alias("mrr"), F.round("precision", 6).alias("precision"), F.round(F.when(F.col("__n") > 0, F.col("__dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


def naive_forecast(series: DataFrame, key: str, at: str, value: str, season: int = 1) -> DataFrame:
    """Adds ``forecast``: the value ``season`` steps before."""
    return series.withColumn("forecast", F.lag(value, season).over(Window.partitionBy(key).orderBy(at)))


def forecast_errors(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mae, rmse, smape) over the rows with a forecast."""
    e = F.col(value) - F.col("forecast")
    share = F.try_divide(2 * F.abs(e), F.abs(F.col(value)) + F.abs("forecast"))
    return rows.where("forecast is not null").groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(share), 6).alias("smape"))
