"""Nearest neighbours of blocks of query vectors: exact, and through an inverted index of cells.

Vectors are compared by cosine distance, as products of matrices over Arrow batches. Every task
keeps its k best per query; only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in one block of query vectors, which each task gets as a whole.
QUERY_BLOCK_VALUES = 1 << 20
#: Rows on which the cells of an index are fitted; all rows are indexed.
FIT_ROWS = 20_000
#: Rounds of the fit, and the queries on which it is tried.
FIT_ROUNDS, TRIED = 12, 200


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; those without length stay zero, so that their distance to all is 1."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the vectors of ``width`` numbers in a list column, without null ones, and where they stand."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == width)
    picked = column.take(pa.array(rows)) if len(rows) < len(column) else column
    flat = picked.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    whole = np.isfinite(values).all(axis=1)
    return rows[whole], values[whole]


def best(query: np.ndarray, item: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by distance, then item."""
    order = np.lexsort((item, distance, query))
    query, item, distance = query[order], item[order], distance[order]
    begins = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1]) if len(query) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
    return query[rank < k], item[rank < k], distance[rank < k]


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of (ids, unit vectors) of queries (query_id, query), each of bounded size."""
    queries = queries.where(F.col("query").isNotNull())
    n_values = queries.select(F.coalesce(F.sum(F.size("query")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_values // QUERY_BLOCK_VALUES))
    for b in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        for width in sorted({len(r["query"]) for r in rows}):
            same = [r for r in rows if len(r["query"]) == width]
            yield [r["query_id"] for r in same], unit(np.array([r["query"] for r in same], dtype=np.float64))


def _search(vectors: DataFrame, id_col: str, vector: str, ids: list, block: np.ndarray, id_kind: str, k: int, pairs: Callable | None) -> DataFrame:
    kind = vectors.schema[id_col].dataType.simpleString()
    extra = ["cell"] if pairs else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0)
        kept = (empty.astype(np.int64), None, empty)
        for b in batches:
            rows, v = matrix(b.column(1), block.shape[1])
            if not len(rows):
                continue
            names = np.array(b.column(0).take(pa.array(rows)).to_pylist())
            v = unit(v)
            for q, at in pairs(np.array(b.column(2))[rows]) if pairs else [(np.arange(len(block)), np.arange(len(rows)))]:
                d = np.round(1 - block[q] @ v[at].T, 6) + 0.0
                if d.shape[1] > k:
                    near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                else:
                    near = np.ones_like(d, dtype=bool)
                i, j = np.nonzero(near)
                found = (q[i], names[at][j], d[i, j])
                kept = best(*(found if kept[1] is None else tuple(map(np.concatenate, zip(kept, found)))), k)
        if kept[1] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in kept[0]]), pa.array(kept[1].tolist()), pa.array(kept[2])], names=["query_id", "item_id", "distance"])

    return vectors.select(id_col, vector, *extra).mapInArrow(run, f"query_id {id_kind}, item_id {kind}, distance double")


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nothing(vectors: DataFrame, queries: DataFrame, id_col: str) -> DataFrame:
    return queries.select("query_id").crossJoin(vectors.select(F.col(id_col).alias("item_id"))).select("query_id", "item_id", F.lit(1.0).alias("distance"), F.lit(1).alias("rank")).limit(0)


def exact_knn(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(query_id, item_id, distance, rank): the k nearest of all vectors for each query.

    ``queries`` has (query_id, query) and runs in blocks against all rows. Ties go to the
    smaller id; distances are rounded to 6 places before ranking, so that the order is stable. A vector
    without length lies at distance 1 from all; null vectors, those with a null or non-finite number, and those of another
    dimension than the query are no candidates. Null queries have no rows.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = [_search(vectors, id_col, vector, ids, block, kind, k, None) for ids, block in _blocks(queries)]
    return _ranked(parts, k) if parts else _nothing(vectors, queries, id_col)


def fit_cells(vectors: DataFrame, id_col: str, vector: str, cells: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centres of ``cells`` cells, fitted on at most ``rows`` vectors (those whose ids hash lowest)."""
    return _centres(_sample(vectors, id_col, vector, rows), cells)


def fit_index(vectors: DataFrame, id_col: str, vector: str, cells: int, k: int, share: float = 0.95, rows: int = FIT_ROWS) -> tuple[np.ndarray, int]:
    """(centres, probes): the cells, and into how many of them a query must look to find ``share`` of its ``k`` nearest.

    Both come from the same at most ``rows`` vectors; the probes are measured on :data:`TRIED` of them as queries against all of them.
    """
    m = _sample(vectors, id_col, vector, rows)
    centres = _centres(m, cells)
    if not centres.size:
        return centres, 0
    asked = m[:TRIED]
    gold = np.argsort(-(asked @ m.T), axis=1, kind="stable")[:, :k]
    cell = (m @ centres.T).argmax(axis=1)[gold]
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(turn, cell, axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))]) + 1


def _sample(vectors: DataFrame, id_col: str, vector: str, rows: int) -> np.ndarray:
    some = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows).select(vector).collect()
    width = max((len(r[0]) for r in some), default=0)
    m = np.array([r[0] for r in some if len(r[0]) == width and None not in r[0]], dtype=np.float64) if some else np.empty((0, 0))
    return unit(m[np.isfinite(m).all(axis=1)]) if m.size else np.empty((0, 0))


def _centres(m: np.ndarray, cells: int) -> np.ndarray:
    cells = min(cells, len(m))
    if not cells:
        return m
    random = np.random.default_rng(0)
    centres = m[random.choice(len(m), cells, replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        filled = np.bincount(nearest, minlength=cells) > 0
        centres = np.where(filled[:, None], unit(sums), m[random.integers(len(m), size=cells)])
    return centres


def indexed(vectors: DataFrame, id_col: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(id, vector, cell): every vector in the cell of its nearest centre. Nothing is shuffled; vectors of no use have cell -1."""
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, {vector} {vectors.schema[vector].dataType.simpleString()}, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.full(b.num_rows, -1, dtype=np.int32)
            if centres.size:
                rows, v = matrix(b.column(1), centres.shape[1])
                cell[rows] = (v @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], names=[id_col, vector, "cell"])

    return vectors.select(id_col, vector).mapInArrow(run, schema)


def index_knn(index: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """Like :func:`exact_knn`, but each query is compared with the vectors of its ``probes`` nearest cells only.

    ``index`` comes from :func:`indexed`. Only cells that a query of the block asks for are read on; with as many probes as cells
    the result is exact.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = []
    for ids, block in _blocks(queries):
        if not centres.size or block.shape[1] != centres.shape[1]:
            continue
        near = np.argsort(-(block @ centres.T), axis=1, kind="stable")[:, :probes]
        asked = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

        def pairs(cell: np.ndarray, asked: dict = asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for c in np.unique(cell):
                if c in asked:
                    yield asked[c], np.flatnonzero(cell == c)

        parts.append(_search(index.where(F.col("cell").isin([int(c) for c in asked])), id_col, vector, ids, block, kind, k, pairs))
    return _ranked(parts, k) if parts else _nothing(index, queries, id_col)
