import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.asof import asof_attributes, iso_instant

T0 = datetime(2020, 1, 1)
EVENTS = "id string, key string, at timestamp"
VERSIONS = "key string, start timestamp, end timestamp, rank timestamp, tie long, a string, b string, at string"


def brute(events, versions):
    out = set()
    for e in set(events):
        if e[1] is None or e[2] is None:
            continue
        alive = [v for v in versions if v[0] == e[1] and v[1] is not None and v[3] is not None and v[1] <= e[2] and (v[2] is None or e[2] < v[2])]
        if alive:
            best = max(alive, key=lambda v: (v[3], v[4]))
            out.add((*e, best[5], best[6]))
    return out


def data(seed, n):
    r = random.Random(seed)
    day = lambda: T0 + timedelta(hours=r.randint(0, 400))
    versions = []
    for _ in range(n):
        s = day()
        versions.append((r.choice("xyz"), s if r.random() < 0.95 else None, None if r.random() < 0.3 else s + timedelta(hours=r.randint(0, 90)), s - timedelta(hours=r.randint(0, 9)), r.randint(1, 5), r.choice(["p", "q", None]), str(r.randint(1, 3)), "clash"))
    events = [(f"e{i}", r.choice(["x", "y", "z", "none", None]), day() if r.random() < 0.95 else None) for i in range(80)]
    return events + events[:5], versions + versions[:3]


@pytest.mark.parametrize("most, task_rows", [(64, 100_000), (64, 10), (2, 100_000), (2, 10)])
def test_matches_brute_force_on_all_paths(spark, most, task_rows):
    """Gaps, overlaps, ties, repeated rows, nulls; extra columns may clash with the event's."""
    for seed in range(2):
        events, versions = data(seed, 40)
        got = asof_attributes(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "key", "at", "start", "end", ["rank", "tie", "a", "b"], ["a", "b"], most, task_rows)
        expect = {x for x in brute(events, [(*v[:4], (v[4], v[5] is not None, v[5] or "", v[6]), *v[5:]) for v in versions])}
        assert {tuple(x) for x in got.collect()} == expect


@pytest.mark.parametrize("most", [64, 0])
def test_times_far_from_now_count_alike(spark, most):
    far = [datetime(1601, 5, 1), datetime(2400, 1, 1), datetime(9000, 1, 1)]
    versions = [("x", far[0], far[1], far[0], 1, "old", None, "c"), ("x", far[1], None, far[1], 1, "new", None, "c")]
    events = [("e1", "x", datetime(1700, 1, 1)), ("e2", "x", datetime(2399, 12, 31)), ("e3", "x", far[1]), ("e4", "x", far[2]), ("e5", "x", datetime(1500, 1, 1))]
    got = asof_attributes(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "key", "at", "start", "end", ["rank", "tie"], ["a"], most)
    assert {(r["id"], r["a"]) for r in got.collect()} == {("e1", "old"), ("e2", "old"), ("e3", "new"), ("e4", "new")}


def test_attributes_may_bear_names_of_event_columns(spark):
    got = asof_attributes(spark.createDataFrame([("e", "x", T0)], EVENTS), spark.createDataFrame([("x", T0, None, T0, 1, "p", None, "c")], VERSIONS), "key", "at", "start", "end", ["rank", "tie"], ["b"])
    assert got.collect() == [("e", "x", T0, None)]


def test_empty_tables(spark):
    none = asof_attributes(spark.createDataFrame([], EVENTS), spark.createDataFrame([], VERSIONS), "key", "at", "start", "end", ["rank"], ["a"])
    assert none.columns == ["id", "key", "at", "a"] and none.count() == 0


def test_iso_forms(spark):
    forms = ["2021-08-06T00:19:00Z", "2019-05-15T02:41:19+02:00", "2025-01-30 00:53:33+0000", "2024-02-03", "2024-02-03T04:05:06.789Z", " 2024-02-03T04:05:06 ", "soon", None, ""]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "t string").select(F.date_format(iso_instant(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS")).collect()]
    assert got == ["2021-08-06 00:19:00.000", "2019-05-15 00:41:19.000", "2025-01-30 00:53:33.000", "2024-02-03 00:00:00.000", "2024-02-03 04:05:06.789", "2024-02-03 04:05:06.000", None, None, None]
