import hashlib
import itertools
import random
from datetime import datetime, timedelta

import pytest

from lodestrata.operators.history import ranged, snapshots_history, version_history

T0 = datetime(2020, 1, 1)
SCHEMA = "k string, at timestamp, v string, id string, valid_from string"


def brute(rows):
    best = {}
    for k, at, v, i, _ in rows:
        if k is not None and at is not None:
            best[k, at, v] = min(i, best.get((k, at, v), i))
    out = set()
    for key in {k for k, _, _ in best}:
        line = sorted((at, v, i) for (k, at, v), i in best.items() if k == key)
        starts = [x for j, x in enumerate(line) if j == 0 or line[j - 1][1] != x[1]]
        out |= {(key, i, at, starts[j + 1][0] if j + 1 < len(starts) else None, v) for j, (at, v, i) in enumerate(starts)}
    return out


@pytest.mark.parametrize("task_rows", [100_000, 3])
def test_versions_match_brute_force_with_and_without_hot_keys(spark, task_rows):
    r = random.Random(3)
    rows = [(r.choice(["x", "y", "hot", "hot", "hot", None]), None if r.random() < 0.05 else T0 + timedelta(days=n), r.choice("ab"), f"i{n % 50:03d}", "clash") for n in range(120)]
    rows += rows[:10]
    got = version_history(spark.createDataFrame(rows, SCHEMA), ["k"], "at", ["v"], "id", task_rows).select("k", "id", "valid_from", "valid_to", "v").collect()
    assert {tuple(x) for x in got} == brute(rows)


def test_nulls_are_values_and_empty_tables_work(spark):
    rows = [("x", T0, None, "a", ""), ("x", T0 + timedelta(1), None, "b", ""), ("x", T0 + timedelta(2), "v", "c", ""), ("x", T0 + timedelta(3), None, "d", "")]
    got = version_history(spark.createDataFrame(rows, SCHEMA), ["k"], "at", ["v"], "id").orderBy("valid_from").select("id", "v", "first", "last").collect()
    assert [tuple(x) for x in got] == [("a", None, True, False), ("c", "v", False, False), ("d", None, False, True)]
    assert version_history(spark.createDataFrame([], SCHEMA), ["k"], "at", ["v"], "id").count() == 0


def test_snapshots_are_numbered(spark):
    rows = [("x", T0 + timedelta(d), v, "", "") for d, v in enumerate("aabba")]
    got = snapshots_history(spark.createDataFrame(rows, SCHEMA), ["k"], "at", ["v"]).orderBy("version").select("version", "v", "snapshots", "valid_to").collect()
    assert [tuple(x) for x in got] == [(1, "a", 2, T0 + timedelta(2)), (2, "b", 2, T0 + timedelta(4)), (3, "a", 1, None)]


@pytest.mark.parametrize("task_rows", [100_000, 3])
def test_numbered_snapshots_match_brute_force_with_and_without_hot_keys(spark, task_rows):
    r = random.Random(6)
    rows = [(r.choice(["x", "y", "hot", "hot", "hot"]), T0 + timedelta(hours=n // 2), r.choice("ab"), "", "") for n in range(120)]
    got = snapshots_history(spark.createDataFrame(rows + rows[:9], SCHEMA), ["k"], "at", ["v"], task_rows).select("k", "version", "valid_from", "valid_to", "snapshots", "v")
    digest = {v: hashlib.md5(f'{{"v":"{v}"}}'.encode()).hexdigest() for v in "ab"}
    want = set()
    for key in {x[0] for x in rows}:
        line = sorted({(x[1], digest[x[2]], x[2]) for x in rows if x[0] == key})
        runs = [list(g) for _, g in itertools.groupby(line, key=lambda x: x[2])]
        want |= {(key, n + 1, g[0][0], runs[n + 1][0][0] if n + 1 < len(runs) else None, len(g), g[0][2]) for n, g in enumerate(runs)}
    assert {tuple(x) for x in got.collect()} == want


def test_a_hot_key_of_one_time_is_cut_into_ranges(spark):
    df = spark.createDataFrame([("hot", T0, f"{n:04d}") for n in range(1000)], "k string, at timestamp, v string")
    sizes = [x["count"] for x in ranged(df, ["k"], ["at", "v"], spark.createDataFrame([("hot",)], "k string"), 100).groupBy("__range").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 5 and max(sizes) < 400
