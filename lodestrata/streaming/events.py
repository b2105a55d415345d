"""Event logs, replays, deduplication, windows and job states, as streams and as batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators.history import neighbours, ranged, running_max_before
from lodestrata.operators.hot import TASK_ROWS, hot_keys

# States of a run and where each may lead.
TRANSITIONS = {
    "queued": ("planning", "cancelled", "failed"), "planning": ("retrieving", "failed", "cancelled"), "retrieving": ("fusing", "failed", "cancelled"),
    "fusing": ("generating", "failed", "cancelled"), "generating": ("verifying", "failed", "cancelled"), "verifying": ("succeeded", "abstained", "failed", "cancelled"),
}


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, once, into Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def replay(events: DataFrame, after: Column, seq: str = "seq") -> DataFrame:
    """Events behind the last one a client has seen."""
    return events.where(F.col(seq) > after)


def first_per_key(events: DataFrame, keys: list[str], at: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """One event per key, null keys alike; in a stream, state is kept for ``delay`` behind the watermark."""
    filled = events.withColumns({f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    names = [f"__{k}" for k in keys]
    if events.isStreaming and at:
        return filled.withWatermark(at, delay).dropDuplicatesWithinWatermark(names).drop(*names)
    return filled.dropDuplicates(names).drop(*names)


def tumbling(events: DataFrame, at: str, size: str, by: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums in windows; with ``late`` a stream drops what comes later than that."""
    e = events.withWatermark(at, late) if late else events
    w = F.window(F.col(at), size, slide) if slide else F.window(F.col(at), size)
    g = e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    g = events.groupBy(*by, F.session_window(F.col(at), gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select(*by, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def stale(jobs: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """Running jobs without a heartbeat for so long."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"INTERVAL {seconds} SECONDS")))


def gaps(events: DataFrame, run: str, seq: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(run, seq, expected): events whose number doesn't follow the one before (the first must be 1). Runs of any length are sorted range by range."""
    hot = hot_keys(events, [run], task_rows)
    e = neighbours(ranged(events, [run], [seq], hot, task_rows), [run], [seq], hot, before={"__last": seq})
    return e.withColumn("expected", F.coalesce("__last", F.lit(0)) + 1).where(F.col(seq) != F.col("expected")).select(run, seq, "expected")


def accepted(events: DataFrame, run: str, arrival: str, seq: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Events numbered above all that arrived before them in their run."""
    hot = hot_keys(events, [run], task_rows)
    e = running_max_before(ranged(events, [run], [arrival], hot, task_rows), [run], [arrival], hot, seq, "__m")
    return e.where(F.col("__m").isNull() | (F.col(seq) > F.col("__m"))).drop("__m", "__range")


def illegal_steps(log: DataFrame, run: str, seq: str, status: str, allowed: dict[str, tuple[str, ...]] | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(run, seq, before, status): steps the state machine doesn't know; every run starts queued."""
    allowed = TRANSITIONS if allowed is None else allowed
    start = next(iter(allowed))
    hot = hot_keys(log, [run], task_rows)
    stepped = neighbours(ranged(log, [run], [seq], hot, task_rows), [run], [seq], hot, before={"before": status})
    legal = F.when(F.col("before").isNull(), F.col(status) == start).otherwise(F.lit(False))
    for a, to in allowed.items():
        legal = legal | ((F.col("before") == a) & F.col(status).isin(*to))
    return stepped.where(~F.coalesce(legal, F.lit(False))).select(run, seq, "before", status)


def claims(jobs: DataFrame, workers: int) -> DataFrame:
    """The first ``workers`` queued jobs by priority, age and id, each with the worker that gets it."""
    head = jobs.where("status = 'queued'").orderBy("priority", "created_at", "id").limit(workers)
    w = Window.orderBy("priority", "created_at", "id")
    return head.withColumn("worker", F.row_number().over(w) - 1).withColumn("attempts", F.col("attempts") + 1)


def after_failure(status: Column, attempts: Column, most: Column) -> Column:
    """A failed attempt goes back to the queue until there have been as many as allowed."""
    return F.when(status != "failed", status).when(attempts < most, "queued").otherwise("failed")
