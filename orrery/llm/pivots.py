"""Exact top-k inner-product search by pivot-table elimination.

Vectors are rounded to integers, floor(scale * x). A table holds the distance of every candidate to
each of `PIVOTS` pivots; with a query's own distances the largest difference is a lower bound of
the distance between query and candidate, which is an upper bound of their inner product. A
query's candidates are evaluated in the order of this bound, until the bound of the next one is
under the k-th score found so far; equal bounds are still evaluated, so ties are settled exactly.

Queries are taken in blocks of at most `QUERY_BLOCK`, each broadcast (its size is bounded), against
all rows; a task keeps k rows for each query of the block, whatever the number of its rows. Pivots
are a bounded choice: the vectors with the smallest hashes.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count
as padded with zeros. A query's own id is no candidate of it; of repeated rows with one query id
the first is the query, while repeated candidate rows each count. Rows without an id take no part.
An empty table gives an empty result. Inner products are exact in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 16
QUERY_BLOCK = 4096
_ROWS = 4096
_STEP = 64


def rounded(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part; every component is a whole number."""
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros or cut to `width` (no query reaches further)."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        out[k, : min(n, width)] = flat[at[k] : at[k] + min(n, width)]
    return out


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while they stay under 2**53, else in integers."""
    if len(rows) == 0 or np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * max(1, rows.shape[1]) < 2**53:
        return (rows @ query).astype(np.int64)
    return rows.astype(np.int64) @ query.astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


class Search:
    """The k best candidates of every query among the rows seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.pivots, self.k = ids, queries, pivots, k
        self.norms = (queries * queries).sum(1)
        self.table = _distances(queries, pivots)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), best first
        self.evaluated = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        norms = (rows * rows).sum(1)
        table = _distances(rows, self.pivots)
        scale = float(norms.max(initial=0))
        for q in range(len(self.ids)):
            low = np.abs(table - self.table[q]).max(1, initial=0)
            slack = 1e-6 * (scale + self.norms[q]) + 1  # rounding of the bounds
            bound = (norms + self.norms[q] - low * low) / 2 + slack
            best = self.best[q]
            floor = -best[-1][0] if len(best) >= self.k else -np.inf
            left = np.nonzero((bound >= floor) & (ids != self.ids[q]))[0]
            left = left[np.argsort(-bound[left], kind="stable")]
            at, step = 0, _STEP
            while at < len(left) and bound[left[at]] >= floor:
                part = left[at : at + step]
                scores = _products(rows[part], self.queries[q])
                self.evaluated += len(part)
                if floor > -np.inf:
                    part, scores = part[scores >= floor], scores[scores >= floor]
                best = sorted(best + list(zip((-scores).tolist(), ids[part].tolist())))[: self.k]
                floor = -best[-1][0] if len(best) >= self.k else -np.inf
                at, step = at + step, step * 2
            self.best[q] = best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to the smaller id.

    `is_query` is a condition over `vec_id`.
    """
    rows = rounded(vectors, id_col, vec_col, scale)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        found = _search(rows, mine.dropDuplicates(["vec_id"]).toArrow(), chosen, k)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: pa.Table, chosen: pa.Table, k: int) -> DataFrame:
    def combined(table: pa.Table, name: str) -> pa.Array:
        column = table.column(name).combine_chunks()
        return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column

    width = max((len(v) for t in (asked,) for v in t.column("v").to_pylist()), default=0)
    query_ids = np.asarray(asked.column("vec_id"), np.int64) if asked.num_rows else np.zeros(0, np.int64)
    queries = _matrix(combined(asked, "v"), width) if asked.num_rows else np.zeros((0, width))
    pivot_rows = _matrix(combined(chosen, "v"), width) if chosen.num_rows else np.zeros((0, width))
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries, pivot_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, table = shared.value
        search = Search(ids, matrix, table, k)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                search.add(np.asarray(part.column(0)), _matrix(part.column(1), matrix.shape[1]))
        found = [(q, i, -s, copy) for q, best in zip(ids.tolist(), search.best) for copy, (s, i) in enumerate(best)]
        columns = list(zip(*found)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score", "copy"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long, copy long")
