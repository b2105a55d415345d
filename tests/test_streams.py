from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import events as E

T0 = datetime(2024, 1, 1)


def test_stream_windows_with_a_watermark(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=i), "a" if i % 2 else "b", 1.0) for i in range(120)]
    spark.createDataFrame(rows, "id long, ts timestamp, kind string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    s = E.tumbling(E.file_stream(spark, str(tmp_path / "in"), schema), "ts", "30 minutes", ["kind"], "value", late="10 minutes")
    E.run_available(s, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["window_start"], r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(T0 + timedelta(minutes=30 * w), k, 15) for w in range(3) for k in "ab"}  # the last window is still open
    E.run_available(s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_dedupe_treats_null_keys_alike(spark):
    df = spark.createDataFrame([("o", "k"), (None, "k"), (None, "k"), ("o", "k")], "org string, key string")
    assert E.first_per_key(df, ["org", "key"]).count() == 2


def test_job_states(spark):
    jobs = spark.createDataFrame([("a", 1, T0, "queued", 0), ("b", 0, T0, "queued", 2), ("c", 0, T0, "running", 1)], "id string, priority int, created_at timestamp, status string, attempts int").withColumn("heartbeat_at", F.lit(T0))
    assert [(r["id"], r["worker"], r["attempts"]) for r in E.claims(jobs, 5).orderBy("worker").collect()] == [("b", 0, 3), ("a", 1, 1)]
    assert [r["id"] for r in E.stale(jobs, F.lit(T0 + timedelta(seconds=61))).collect()] == ["c"]
    assert [r["id"] for r in E.stale(jobs, F.lit(T0 + timedelta(seconds=60))).collect()] == []
    got = spark.createDataFrame([("failed", 1, 3), ("failed", 3, 3), ("succeeded", 1, 3)], "s string, a int, m int").select(E.after_failure(F.col("s"), F.col("a"), F.col("m")))
    assert [r[0] for r in got.collect()] == ["queued", "failed", "succeeded"]


def test_gaps_and_illegal_steps(spark):
    log = spark.createDataFrame([("r", 1, "queued"), ("r", 2, "planning"), ("r", 4, "succeeded"), ("s", 1, "planning")], "run string, seq int, status string")
    assert [(r["run"], r["seq"], r["expected"]) for r in E.gaps(log, "run", "seq").collect()] == [("r", 4, 3)]
    assert {(r["run"], r["seq"]) for r in E.illegal_steps(log, "run", "seq", "status").collect()} == {("r", 4), ("s", 1)}
    arrivals = spark.createDataFrame([("r", 1, 5), ("r", 2, 3), ("r", 3, 6)], "run string, at int, seq int")
    assert sorted(r["seq"] for r in E.accepted(arrivals, "run", "at", "seq").collect()) == [5, 6]


@pytest.mark.parametrize("gap, n", [("5 minutes", 2), ("30 minutes", 1)])
def test_sessions(spark, gap, n):
    df = spark.createDataFrame([("u", T0), ("u", T0 + timedelta(minutes=4)), ("u", T0 + timedelta(minutes=20))], "u string, ts timestamp")
    assert E.sessions(df, ["u"], "ts", gap).count() == n


def test_long_runs_are_parted_and_give_the_same(spark):
    import random

    from lodestrata.operators import ingest, quality

    r = random.Random(9)
    log = spark.createDataFrame([(r.choice(["hot", "hot", "hot", "x"]), n, r.choice(["queued", "planning", "failed"]), float(r.randint(0, 9))) for n in range(1, 150)], "run string, seq int, status string, v double")
    for f in (lambda k: E.gaps(log, "run", "seq", k), lambda k: E.illegal_steps(log, "run", "seq", "status", None, k), lambda k: E.accepted(log, "run", "seq", "v", k), lambda k: quality.budget(log, "run", "seq", "v", 50, k), lambda k: ingest.value_links(log, ["run"], ["seq"], "status", "seq", k)):
        whole, parted = (sorted(map(tuple, (lambda d: d.select(*sorted(d.columns)))(f(k)).collect()), key=str) for k in (100_000, 10))
        assert whole == parted and whole
