"""Filing sources: indexes, company facts, series, bars, questions. Nothing is inferred; schemas are stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBMISSIONS = "cik string, name string, tickers array<string>, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, primaryDocument: array<string>>>"
COMPANY_FACTS = "cik bigint, entityName string, facts map<string, map<string, struct<label: string, description: string, units: map<string, array<struct<start: string, `end`: string, val: string, accn: string, fy: int, fp: string, form: string, filed: string, frame: string>>>>>>"
SERIES = "realtime_start string, realtime_end string, observations array<struct<date: string, value: string, realtime_start: string, realtime_end: string>>"
# Fixed value: the fields a daily bar must have.
BAR_FIELDS = ("adjusted_close", "volume", "dividend", "split_factor")


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON files under a stated schema; numbers asked for as text keep all their digits."""
    return spark.read.schema(schema).option("multiLine", not lines).option("primitivesAsString", True).json(path)


def padded_cik(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


def filing_list(submissions: DataFrame, forms: list[str] | None = None, base_url: str = "https://filings.example") -> DataFrame:
    """(cik, accession, form, filed_on, bad_date, url) of the parallel arrays of an index.

    Filings whose date can't be read have ``bad_date`` true and a null date.
    """
    r = F.col("filings.recent")
    rows = submissions.select(padded_cik(F.col("cik")).alias("cik"), F.explode(F.arrays_zip(r["accessionNumber"].alias("accession"), r["form"].alias("form"), r["filingDate"].alias("day"), r["primaryDocument"].alias("file"))).alias("f")).select("cik", "f.*")
    if forms is not None:
        rows = rows.where(F.col("form").isin(forms) if forms else F.lit(False))
    day = F.col("day").try_cast("date")
    url = F.concat_ws("/", F.lit(base_url), F.regexp_replace("cik", "^0+", ""), F.regexp_replace("accession", "-", ""), F.col("file"))
    return rows.select("cik", "accession", "form", day.alias("filed_on"), day.isNull().alias("bad_date"), url.alias("url"))


def company_observations(facts: DataFrame) -> DataFrame:
    """One row per observation: taxonomy, concept, unit, period, value text, filing, and a code where it can't be used."""
    t = facts.select("cik", F.explode("facts").alias("taxonomy", "concepts")).select("cik", "taxonomy", F.explode("concepts").alias("concept", "c"))
    u = t.select("cik", "taxonomy", "concept", "c.label", F.explode("c.units").alias("unit", "obs")).withColumn("o", F.explode("obs"))
    value, end = F.col("o.val"), F.col("o.end").try_cast("date")
    code = F.when(value.isNull(), "MISSING_VALUE").when(~value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "NON_FINITE_OR_TEXT").when(end.isNull(), "BAD_DATE").when(F.col("o.start").isNotNull() & (F.col("o.start").try_cast("date").isNull() | (F.col("o.start").try_cast("date") > end)), "BAD_PERIOD")
    return u.select("cik", "taxonomy", "concept", "label", "unit", F.when(F.col("o.start").isNull(), "instant").otherwise("duration").alias("period_type"), F.col("o.start").try_cast("date").alias("period_start"), end.alias("period_end"), value.alias("value"), F.col("o.accn").alias("accession"), F.col("o.form").alias("form"), F.col("o.filed").try_cast("date").alias("filed_on"), code.alias("code"))


def series_known(vintages: DataFrame, as_of_day: Column) -> DataFrame:
    """Latest value of each observation as published up to a day; ``.`` means missing and gives no row.

    Vintages have (series_id, published_on, observed_on, value).
    """
    v = vintages.where((F.col("published_on") <= as_of_day) & (F.trim("value") != "."))
    return v.groupBy("series_id", "observed_on").agg(F.max_by("value", F.struct("published_on", "value")).alias("value")).withColumn("value", F.col("value").try_cast("decimal(38,10)"))


def daily_bars(bars: DataFrame, first: Column, last: Column) -> DataFrame:
    """Bars in a range of days with a code: MISSING_FIELD, BAD_PRICE, BAD_SPLIT, BAD_DIVIDEND or DUPLICATE_DAY."""
    missing = F.lit(False)
    for f in BAR_FIELDS:
        missing = missing | F.col(f).isNull()
    within = bars.where(F.col("day").between(first, last))
    days = within.groupBy("ticker", "day").agg(F.count("*").alias("__n"))
    code = F.when(missing, "MISSING_FIELD").when(F.col("adjusted_close") <= 0, "BAD_PRICE").when(F.col("split_factor") <= 0, "BAD_SPLIT").when(F.col("dividend") < 0, "BAD_DIVIDEND").when(F.col("__n") > 1, "DUPLICATE_DAY")
    return within.join(days, ["ticker", "day"]).withColumn("code", code).drop("__n")


def questions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path)
