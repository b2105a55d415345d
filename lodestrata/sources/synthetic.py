"""Deterministic synthetic corpora: what an issuer files follows from its number alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import uuid5

SPACE = "6ba7b8119dad11d180b400c04fd430c8"
# Fixed value: forms an issuer cycles through.
FORMS = ("10-K", "10-Q", "8-K", "10-Q/A", "20-F")


def synthetic_filings(spark: SparkSession, issuers: int, filings: int) -> DataFrame:
    """(entity_id, cik, accession, form, value): values come from hashes, every seventh issuer is broken."""
    rows = spark.range(issuers).select(F.col("id").alias("issuer")).withColumn("filing", F.explode(F.sequence(F.lit(0), F.lit(filings - 1))))
    name = F.concat(F.lit("issuer:"), F.col("issuer").cast("string"))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", name, F.col("filing").cast("string")), 256), 1, 12), 16, 10).cast("bigint")
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), ((F.col("issuer") + F.col("filing")) % len(FORMS) + 1).cast("int"))
    return rows.select(
        uuid5(SPACE, name).alias("entity_id"), F.lpad((F.col("issuer") + 1).cast("string"), 12, "0").alias("cik"),
        F.concat_ws("-", F.lpad((F.col("issuer") + 1).cast("string"), 10, "9"), F.lit("24"), F.lpad(F.col("filing").cast("string"), 6, "0")).alias("accession"),
        form.alias("form"), (number % 1_000_000).alias("value"), (F.col("issuer") % 7 == 6).alias("broken"),
    )
