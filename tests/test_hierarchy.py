import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as H


def brute(parent):
    parent = {k: (p if p in parent else None) for k, p in parent.items()}
    out = {}
    for k in parent:
        path, seen = [k], {k}
        while parent[path[-1]] is not None and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        back = parent[path[-1]]
        if back is None:
            out[k] = [path[-1], len(path) - 1, 0]
        else:
            out[k] = [min(path[path.index(back):]), -1, -1]
    for k in parent:
        if out[k][1] > 0:
            p = parent[k]
            while p is not None:
                out[p][2] += 1
                p = parent[p]
    return {(k, *v) for k, v in out.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, parent string, label string, depth int, root string")
    return H.hierarchy(H.links(df, F.col("id"), F.col("parent"), F.col("label"), kw.pop("block", None)), **kw)


@pytest.mark.parametrize("block, block_rows", [(None, 250_000), ("left(id, 3)", 16), ("if(id > '0080', null, 'x')", 40), ("left(id, 2)", 5)])
def test_random_forests_with_loops(spark, block, block_rows):
    """In one task, in blocks with links between them, and by doubling where trees fit no task."""
    r = random.Random(7)
    ids = [f"{i:04x}" for i in range(260)]
    parent = {k: r.choice([None, "gone", *ids[:i]]) if i else None for i, k in enumerate(ids)}
    for i in range(40, 90):
        parent[ids[i]] = ids[i - 1]  # a deep chain
    loop = ids[200:207]
    for i, k in enumerate(loop):
        parent[k] = loop[(i + 1) % len(loop)]
    parent[ids[220]] = ids[220]
    parent[ids[230]], parent[ids[231]] = ids[203], ids[230]
    rows = [(k, p, f"h{k}", 1, "clash") for k, p in parent.items()]
    tree = run(spark, rows + rows[:9], with_paths=True, block=block and F.expr(block), block_rows=block_rows).cache()
    got = {(x["id"], x["root"], x["depth"], x["n_descendants"]) for x in tree.collect()}
    assert got == brute(parent)
    by = {x["id"]: x for x in tree.collect() if not x["looped"]}
    for k, x in by.items():
        p = parent[k] if parent[k] in by else None
        assert x["path"] == (by[p]["path"] if p else []) + [f"h{k}"]
        if p:
            assert by[p]["lo"] < x["lo"] and x["hi"] <= by[p]["hi"]
    asked = spark.createDataFrame([(ids[40],), (ids[0],)], "id string")
    below = H.descendants(tree, asked).groupBy("ancestor").count().collect()
    assert {r["ancestor"]: r["count"] for r in below} == {k: by[k]["n_descendants"] for k in (ids[40], ids[0]) if by[k]["n_descendants"]}
    tree.unpersist()


def test_nulls_empty_and_double_parents(spark):
    assert run(spark, []).count() == 0
    got = {(x["id"], x["root"], x["depth"]) for x in run(spark, [("b", "c", None, 0, ""), ("b", "a", None, 0, ""), ("a", None, None, 0, ""), ("c", None, None, 0, ""), (None, "a", None, 0, "")]).collect()}
    assert got == {("a", "a", 0), ("c", "c", 0), ("b", "a", 1)}


def test_layout_of_long_loops_and_wide_parents():
    import numpy as np

    n = 5000
    parent = np.arange(n) - 1  # one chain
    assert H.lay_out(parent)["depth"].max() == n - 1
    ring = np.roll(np.arange(n), 1)
    assert set(H.lay_out(ring)["root"]) == {0} and set(H.lay_out(ring)["depth"]) == {-1}
    star = np.zeros(n, dtype=int)
    star[0] = -1
    out = H.lay_out(star)
    assert list(out["lo"]) == list(range(n)) and out["hi"][0] == n
    tail = np.concatenate([[2, 0, 1], np.arange(2, n - 1)])  # a loop of three with a chain below
    assert set(H.lay_out(tail)["root"]) == {0} and H.lay_out(tail)["depth"].max() == -1
    assert len(H.lay_out(np.empty(0, dtype=int))["lo"]) == 0
