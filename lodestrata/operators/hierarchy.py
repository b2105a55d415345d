"""Trees of unknown depth from parent-child links, as nested sets.

Nodes come in blocks that most links don't leave (the filing of a section, say). Each block is laid out by itself: subtree sizes
upward, the ranges of siblings by prefix sums downward; what neither pass reaches is on or below a loop. Only trees
that links between blocks tie together are laid out again, together in one task if they fit one, else by
pointer doubling over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.history import ranged, running_sum
from lodestrata.operators.hot import TASK_ROWS, hot_counts, hot_keys, spread_join
from lodestrata.operators.stab import around, cover
from lodestrata.plans.tables import cut, remove

#: Nodes that one task lays out together.
BLOCK_ROWS = 250_000


def links(rows: DataFrame, id_col: Column, parent_col: Column, label: Column | None = None, block: Column | None = None) -> DataFrame:
    """(id, parent[, label][, block]) with one row per id, for :func:`hierarchy`.

    Repeated rows count once; of several parents (labels, blocks) given for one id the smallest counts.
    """
    more = {"label": label, "block": block}
    cols = [id_col.alias("id"), parent_col.alias("parent"), *[c.alias(n) for n, c in more.items() if c is not None]]
    return rows.select(*cols).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"), *[F.min(n).alias(n) for n, c in more.items() if c is not None])


def _levels(parent: np.ndarray, tops: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Nodes level by level below ``tops``, and which nodes were reached. Children come in the order of their numbers."""
    order = np.argsort(parent, kind="stable")
    ordered = parent[order]
    reached = np.zeros(len(parent), dtype=bool)
    levels, level = [], tops
    while len(level):
        reached[level] = True
        levels.append(level)
        first, last = np.searchsorted(ordered, level), np.searchsorted(ordered, level, side="right")
        n = last - first
        level = order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        level = level[~reached[level]]
    return levels, reached


def lay_out(parent: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges of nodes that are numbered in the order of their ids; ``parent`` is -1 for a root.

    root, depth, lo, hi of each node; those on or below loops have depth -1, and the smallest node of the loop as root.
    """
    n = len(parent)
    root, depth, lo = np.arange(n), np.full(n, -1), np.zeros(n, dtype=np.int64)
    size = np.ones(n, dtype=np.int64)
    levels, reached = _levels(parent, np.flatnonzero(parent < 0))
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    for d, level in enumerate(levels):
        depth[level] = d
        if d:
            up, own = parent[level], size[level]  # siblings lie side by side, in the order of their ids
            total = np.cumsum(own) - own
            begins = np.concatenate([[True], up[1:] != up[:-1]])
            ahead = total - np.repeat(total[begins], np.diff(np.append(np.flatnonzero(begins), len(up))))
            lo[level] = lo[up] + 1 + ahead
            root[level] = root[up]
    lost = np.flatnonzero(~reached)
    if len(lost):
        up, least = parent.copy(), np.arange(n)
        for _ in range(int(len(lost)).bit_length() + 1):
            least[lost] = np.minimum(least[lost], least[up[lost]])
            up[lost] = up[up[lost]]
        root[lost] = least[up[lost]]  # the images under so many steps are on the loop, whose least node all of them know
    return {"root": root, "depth": depth, "lo": lo, "hi": lo + size}


def _paths(parent: np.ndarray, depth: np.ndarray, labels: pa.Array) -> pa.Array:
    """The labels from the root to each node; null on and below loops."""
    sizes = depth + 1
    ends = np.cumsum(sizes)
    steps, at = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64), np.flatnonzero(sizes)
    node, place = at, ends[at] - 1
    while len(node):
        steps[place] = node
        go = parent[node] >= 0
        node, place = parent[node[go]], place[go] - 1
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(sizes == 0, False))
    return pa.ListArray.from_arrays(offsets, labels.take(pa.array(steps)))


def solved(nodes: DataFrame, key: Column, blocks: int, labels: bool) -> DataFrame:
    """Adds root, depth, lo, hi, looped, outside[, path] within the nodes of a task; those with equal ``key`` are in one.

    ``outside``: the parent is given but not in the task, so the node is the root of a part only.
    """
    kept = ["id", "parent", *(["label"] if labels else [])]
    kind = nodes.schema["id"].dataType.simpleString()
    more = f"root {kind}, depth int, lo bigint, hi bigint, looped boolean, outside boolean" + (", path array<string>" if labels else "")
    schema = ", ".join([f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept]) + ", " + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        t = t.take(pc.sort_indices(t, [("id", "ascending")])).combine_chunks()
        ids = t.column("id").chunk(0) if t.num_rows else None
        if ids is None:
            return
        given = t.column("parent").chunk(0)
        at = pc.index_in(given, value_set=ids)
        parent = np.where(given.is_null().to_numpy(zero_copy_only=False), -1, at.fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64)
        out = lay_out(parent)
        columns = [t.column(c).chunk(0) for c in kept]
        columns += [ids.take(pa.array(out["root"])), pa.array(out["depth"].astype(np.int32)), pa.array(out["lo"]), pa.array(out["hi"]), pa.array(out["depth"] < 0)]
        columns.append(pc.and_(given.is_valid(), at.is_null()))
        if labels:
            columns.append(_paths(parent, out["depth"], t.column("label").chunk(0)))
        names = [*kept, "root", "depth", "lo", "hi", "looped", "outside", *(["path"] if labels else [])]
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for i in range(0, whole.num_rows, 20_000):
            yield whole.slice(i, 20_000)

    return nodes.withColumn("__key", key).repartition(blocks, "__key").select(*kept).mapInArrow(run, schema)


def tops(edges: DataFrame) -> DataFrame:
    """(id, top): where following ``up`` from each node ends; on and below a loop, the smallest id on it.

    By doubling. In round k those are on the way whose 2^k-th node has another above it: of the nodes in trees at least one
    arrives in every round; once their number stands still, the others are on or below loops.
    """
    state, before = edges, None
    while True:
        onward = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = cut(spread_join(state, onward, ["up"], "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("on")), drop=state if before is not None else None)
        left = state.where("on").count()
        if not left:
            return state.select("id", F.col("up").alias("top"))
        if left == before:
            lost = edges.join(state.where("on").select("id"), "id", "left_semi")
            looped = loop_roots(lost.withColumnRenamed("up", "parent")).withColumnRenamed("root", "top")
            return state.where("not on").select("id", F.col("up").alias("top")).unionByName(looped)
        before = left


def subtree_sizes(linked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, below): how many nodes lie below, upward; and (id) of the nodes on or below loops.

    ``linked`` has (id, up) of all nodes with a parent. In round k those with an ancestor
    2^k above take part: ``n`` counts what lies less than 2^k below (itself included), and
    is added to that ancestor, combined before the shuffle. So only deeper nodes go on, and
    a tree of depth d takes log2(d) rounds. Of the nodes in trees at least one drops out in
    every round; once their number stands still, the others are unprocessed for good.
    Nodes without any below have no row.
    """
    active = linked.select("id", "up", F.lit(1).cast("bigint").alias("n"))
    left, sums, first = active.count(), [], True
    while left:
        more = cut(active.groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more")))
        sums.append(more)
        above = active.select(F.col("id").alias("up"), F.col("up").alias("next"))
        onward = spread_join(active, above, ["up"]).select("id", F.col("next").alias("up"), "n")
        onward = onward.join(more, "id", "left").select("id", "up", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        active, before = cut(onward, drop=None if first else active), left
        left, first = active.count(), False
        if left == before:
            break
    below = None
    for x in sums:
        below = x if below is None else below.unionByName(x)
    below = linked.select("id", F.lit(0).cast("bigint").alias("below")).limit(0) if below is None else cut(below.groupBy("id").agg(F.sum("more").alias("below")))
    for x in sums:
        remove(x)
    return below, active.select("id") if left else None


def sibling_offsets(linked: DataFrame, below: DataFrame) -> DataFrame:
    """(id, up, n, off): size of each subtree and where its range starts within its parent's.

    Siblings are laid out in the order of their ids, by prefix sums; those of a parent with very many children are
    summed range by range, and over one row per range.
    """
    kids = linked.join(below, "id", "left").select("id", "up", (F.coalesce("below", F.lit(0)) + 1).alias("n"))
    hot = hot_keys(kids, ["up"], TASK_ROWS)
    summed = running_sum(ranged(kids, ["up"], ["id"], hot), ["up"], ["id"], hot, "n", "__upto")
    return summed.select("id", "up", "n", (F.col("__upto") - F.col("n") + 1).alias("off"))


def nested_sets(nodes: DataFrame, linked: DataFrame, below: DataFrame, labels: bool) -> DataFrame:
    """(id, root, depth, lo, hi[, path]) of all nodes in trees: preorder ranges, downward.

    ``lo`` numbers the nodes of a tree in preorder from 0, ``hi`` is the end of the node's
    range: all below it, and only they, have lo in (lo, hi). Offsets (and labels) add up
    along the ancestors by doubling, among the nodes that still have an ancestor 2^k above
    which has one itself; the others then take up the values of that ancestor, already known.
    """
    path = ["path"] if labels else []
    tops = nodes.join(linked.select("id"), "id", "left_anti").join(below, "id", "left")
    tops = tops.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("lo"), (F.coalesce("below", F.lit(0)) + 1).alias("hi"), *([F.array("label").alias("path")] if labels else []))
    known = cut(tops)
    active = sibling_offsets(linked, below)
    if labels:
        active = active.join(nodes.select("id", F.array("label").alias("path")), "id")
    active = cut(active)
    left, step = active.count(), 1
    while left:
        above = active.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("off").alias("__off"), *[F.col(p).alias(f"__{p}") for p in path])
        doubled = cut(spread_join(active, above, ["up"], "left").select("id", "n", F.col("__up").isNotNull().alias("on"), F.coalesce("__up", "up").alias("up"), (F.col("off") + F.coalesce("__off", F.lit(0))).alias("off"), *([F.when(F.col("__path").isNotNull(), F.concat("__path", "path")).otherwise(F.col("path")).alias("path")] if labels else [])), drop=active)
        settled, active = doubled.where("not on").drop("on"), doubled.where("on").drop("on")
        active._cut_path = doubled._cut_path
        before, left = left, active.count()
        found = known.select(F.col("id").alias("up"), "root", F.col("depth").alias("__depth"), F.col("lo").alias("__lo"), *[F.col(p).alias(f"__{p}") for p in path])
        lo = F.col("off") + F.col("__lo")
        known = known.unionByName(cut(spread_join(settled, found, ["up"]).select("id", "root", (F.col("__depth") + step).alias("depth"), lo.alias("lo"), (lo + F.col("n")).alias("hi"), *([F.concat("__path", "path").alias("path")] if labels else []))))
        if left == before:
            break
        step *= 2
    return known


def loop_roots(unprocessed: DataFrame) -> DataFrame:
    """(id, root) of nodes on or below loops: the smallest id on the loop.

    The images of the nodes under 2^k steps shrink to the nodes on loops; when their number
    stands still they are those nodes. Minima over the next 2^k nodes then double until no
    minimum of a node on a loop changes.
    """
    state = cut(unprocessed.select("id", F.col("parent").alias("up"), F.col("id").alias("least")))
    reached, changed = None, True
    while True:
        ring = cut(state.select(F.col("up").alias("id")).distinct())
        now = ring.count()
        if now == reached and not changed:
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("other"))
        after = cut(state.join(above, "up").select("id", F.col("next").alias("up"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("fell")), drop=state)
        changed = not after.where("fell").join(ring, "id", "left_semi").isEmpty()
        remove(ring)
        state, reached = after, now
    above = state.select(F.col("id").alias("up"), F.col("least").alias("root"))
    return state.select("id", "up").join(above, "up").select("id", "root")


def spread_out(nodes: DataFrame, with_paths: bool) -> DataFrame:
    """(id, root, depth, lo, hi, looped[, path]) by pointer doubling over all tasks, for trees that fit no task."""
    nodes = cut(nodes)
    linked = cut(spread_join(nodes.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("up")), nodes.select(F.col("id").alias("up")), ["up"], "left_semi"))
    below, unprocessed = subtree_sizes(linked)
    out = nested_sets(nodes, linked, below, with_paths).withColumn("looped", F.lit(False))
    if unprocessed is not None:
        lost = loop_roots(linked.join(unprocessed, "id", "left_semi").withColumnRenamed("up", "parent"))
        out = out.unionByName(lost.withColumns({"depth": F.lit(-1), "looped": F.lit(True)}), allowMissingColumns=True)
    return out


def hierarchy(nodes: DataFrame, with_paths: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node: (id, root, depth, lo, hi, n_descendants, looped[, path]).

    ``nodes`` has (id, parent[, label][, block]), one row per id, as :func:`links` makes it. A node
    without a parent, or whose parent is no id, is a root. ``lo`` numbers the nodes of a tree in preorder from 0,
    siblings in the order of their ids; the descendants of a node are those of the same root with lo in (lo, hi). Nodes on or below a loop have
    ``looped`` true, the smallest id on the loop as root, depth and n_descendants -1, and no range or path.

    ``block`` says which nodes likely belong together and only decides the plan: blocks beyond ``block_rows`` are parted,
    and links may lead anywhere.
    """
    out = ["id", "root", "depth", "lo", "hi", "looped", *(["path"] if with_paths else [])]
    nodes = cut(nodes if "block" in nodes.columns else nodes.withColumn("block", F.xxhash64("id")))
    n = nodes.count()
    blocks = lambda rows: max(-(-rows // block_rows), min(rows // 20_000 + 1, nodes.sparkSession.sparkContext.defaultParallelism))
    hot = hot_counts(nodes.where(F.col("block").isNotNull()).select("block"), ["block"], block_rows // 2)
    key, placed = F.when(F.col("block").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("block")), nodes
    if hot is not None:
        placed = nodes.join(hot.select("block", F.ceil(F.col("__rows") * 2 / block_rows).alias("__parts")), "block", "left")
        key = F.xxhash64(key, F.pmod(F.xxhash64("id"), F.coalesce("__parts", F.lit(1))))
    first = cut(solved(placed, key, blocks(n), with_paths), drop=nodes)
    outside = first.where("outside").select(F.col("id"), F.col("parent").alias("up"))
    edges = cut(spread_join(outside, first.select(F.col("id").alias("up"), "root"), ["up"]).select("id", F.col("root").alias("up")))
    if edges.isEmpty():
        return _finished(first.select(*out))
    top = tops(edges)
    tied = cut(top.unionByName(top.select(F.col("top").alias("id"), "top")).distinct())
    rest = first.join(tied.select(F.col("id").alias("root")), "root", "left_anti").select(*out)
    again = spread_join(first, tied.select(F.col("id").alias("root"), "top"), ["root"]).select("id", "parent", "top", *(["label"] if with_paths else []))
    again = cut(again)
    large = hot_counts(again.select("top"), ["top"], block_rows)
    small = again if large is None else again.join(large.select("top"), "top", "left_anti")
    result = rest.unionByName(solved(small, F.col("top"), blocks(again.count()), with_paths).select(*out))
    if large is not None:
        wide = spread_out(again.join(large.select("top"), "top", "left_semi").drop("top"), with_paths)
        result = result.unionByName(wide.select(*[F.col(c) if c in wide.columns else F.lit(None).alias(c) for c in out]))
    return _finished(result)


def _finished(rows: DataFrame) -> DataFrame:
    """Ranges of nodes on or below loops are void."""
    free = lambda c: F.when(~F.col("looped"), F.col(c)).alias(c)
    below = F.when(F.col("looped"), F.lit(-1).cast("bigint")).otherwise(F.col("hi") - F.col("lo") - 1)
    return rows.select("id", "root", "depth", free("lo"), free("hi"), below.alias("n_descendants"), "looped", *([free("path")] if "path" in rows.columns else []))


#: Preorder numbers lie below 2 to this power.
RANGE_BITS = 40


def descendants(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(ancestor, id, below): everything below the nodes in ``asked`` (column id).

    By nested sets: the range of an ancestor falls into aligned intervals, and the number of each node lies in one of every
    size; both meet where they share root and interval, so only true pairs are made, however many are asked for.
    """
    free = tree.where(~F.col("looped"))
    top = free.join(asked.select("id").distinct(), "id", "left_semi").where(F.col("hi") > F.col("lo") + 1)
    top = top.select(F.col("id").alias("ancestor"), "root", F.col("depth").alias("__depth"), F.explode(cover(F.col("lo") + 1, F.col("hi"), RANGE_BITS)).alias("__n"))
    sizes = [r[0] for r in top.select("__n.level").distinct().collect()]  # at most RANGE_BITS
    nodes = free.select("id", "root", "depth", F.explode(F.filter(around(F.col("lo"), RANGE_BITS), lambda n: n["level"].isin(sizes))).alias("__n"))
    return nodes.join(top, ["root", "__n"]).select("ancestor", "id", (F.col("depth") - F.col("__depth")).alias("below"))
