"""Nearest neighbours by a block matrix join: int8 product tiles, error bounds, exact distances, heaps.

Queries are dealt into blocks of about BLOCK rows.  For each block, every task goes
through its own vectors in tiles: one matrix product of int8 codes gives, for all
pairs of a tile, a distance between the quantised vectors.  Each vector knows how far
it is from its quantised form, so the triangle inequality bounds the true distance
from both sides.  A pair whose lower bound is above the query's current limit is out;
the others are computed in doubles from the original components and go through a heap
per query.  Spark merges the heaps of all tasks.  The bounds are proven, so the
result is that of comparing every pair, with recall 1.

A block of queries is all that is sent to the tasks, and it is bounded; candidates
stay where they are read and are never shuffled.  Each block's result is written to
the shared folder, so neither the driver nor a task ever holds more than one block.

Defined results: null, empty and zero vectors, those that hold a null or non-finite
component, and rows without a vec_id take no part.  A pair of different lengths is no
pair.  A row is its query's own if it has the query's vec_id, so copies under other
ids are found, at distance 0, smaller vec_id first.  Rows that repeat a candidate are
found as often as they stand there; a query that repeats another in all respects
counts once.  Other columns are not read.  No usable rows give no result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch
from .vectors import usable

#: Queries in a block, about; the block's matrices are what is sent to the tasks.
BLOCK = 16_384
#: Queries and candidates of a tile.
TILE = (512, 2048)
SCHEMA = "query int, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Coded:
    """Vectors, their int8 codes, and for each the scale, the squared length of the coded form and a bound of its distance from the original."""

    x: np.ndarray
    code: np.ndarray
    scale: np.ndarray
    square: np.ndarray
    error: np.ndarray

    def part(self, rows: slice | np.ndarray) -> Coded:
        return Coded(self.x[rows], self.code[rows], self.scale[rows], self.square[rows], self.error[rows])


def coded(x: np.ndarray) -> Coded:
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    form = code * scale[:, None]
    # a little more than computed, for the rounding of this very computation
    error = np.sqrt(((x - form) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-10 * scale
    return Coded(x, code, scale, scale * scale * (code.astype(np.int64) ** 2).sum(axis=1), error)


def products(a: Coded, b: Coded) -> np.ndarray:
    """Products of all pairs of codes; below 2^24 they are exact in single precision, where matrix products are fastest."""
    kind = np.float32 if a.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.code.astype(kind) @ b.code.astype(kind).T


def between(a: Coded, b: Coded, upper: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Lower bounds of the distances of all pairs, and upper ones where asked."""
    size = a.square[:, None] + b.square[None, :]
    square = size - (2 * a.scale[:, None] * b.scale[None, :]) * products(a, b)
    slack = a.error[:, None] + b.error[None, :]
    low = np.sqrt(np.maximum(square - 1e-13 * size, 0)) - slack
    return low, np.sqrt(np.maximum(square, 0) + 1e-13 * size) + slack if upper else None


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed up from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        apart = a[:, i] - b[:, i]
        total += apart * apart
    return np.sqrt(total)


class Heaps:
    """The k nearest candidates of each query so far; the worst of them is on top."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.limit = k, [[] for _ in range(queries)], np.full(queries, np.inf)

    def offer(self, query: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        for q, d, i in zip(query.tolist(), far.tolist(), ids.tolist(), strict=True):
            heap = self.held[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (-d, -i))
            elif (-d, -i) > heap[0]:
                heapq.heapreplace(heap, (-d, -i))
            if len(heap) == self.k:
                self.limit[q] = -heap[0][0]

    def search(self, ids: np.ndarray, queries: Coded, own: np.ndarray, found: Coded) -> None:
        """Compare all queries with candidates (own: their vec_ids), tile by tile."""
        for a in range(0, len(ids), TILE[0]):
            rows = slice(a, a + TILE[0])
            q = queries.part(rows)
            for b in range(0, len(own), TILE[1]):
                c, names = found.part(slice(b, b + TILE[1])), own[b : b + TILE[1]]
                other, limit = ids[rows][:, None] != names[None, :], self.limit[rows]
                first = len(names) > self.k and not np.isfinite(limit).all()
                low, high = between(q, c, first)
                if first:
                    # k candidates of this tile are no farther than this
                    high[~other] = np.inf
                    limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
                # what cannot be compared (overflow) is kept, too
                i, j = np.nonzero(~(low > limit[:, None]) & other)
                self.offer(i + a, distances(q.x[i], c.x[j]), names[j])


def _searched(vectors: DataFrame, block: dict[int, tuple[np.ndarray, Coded]], k: int) -> DataFrame:
    """The k nearest of each task's vectors for a block of queries: number of components to vec_ids and vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {n: Heaps(len(ids), k) for n, (ids, _) in sent.value.items()}
        for batch in batches:
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for n, (at, x) in usable(batch.column("embedding")).items():
                at, x = at[x.any(axis=1)], x[x.any(axis=1)]
                if n in heaps and len(at):
                    heaps[n].search(*sent.value[n], own[at].astype(np.int64), coded(x))
        numbered = enumerate((i, heap) for n, (ids, _) in sent.value.items() for i, heap in zip(ids.tolist(), heaps[n].held, strict=True))
        found = [(q, i, -b, -a) for q, (i, heap) in numbered for a, b in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)], ["query", "query_id", "vec_id", "score"])

    return vectors.mapInArrow(rows, SCHEMA)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors to each row of queries, both (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").distinct()
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)))
    # queries of one id are told apart by their number in the block
    best, out = Window.partitionBy("query").orderBy("score", "vec_id"), None
    for number in range(blocks):
        held = _held(dealt.where(F.col("_block") == number).toArrow())
        rows = _searched(vectors, held, k) if held else spark.createDataFrame([], SCHEMA)
        ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = ranked if blocks == 1 else scratch(ranked)[0]
        out = part if out is None else out.unionByName(part)
    return out


def _held(rows: pa.Table) -> dict[int, tuple[np.ndarray, Coded]]:
    if not rows.num_rows:
        return {}
    ids, found = rows.column("vec_id").to_numpy(), {}
    for n, (at, x) in usable(rows.column("embedding").combine_chunks()).items():
        some = x.any(axis=1)
        if some.any():
            found[n] = ids[at[some]], coded(x[some])
    return found


def is_query(vec_id: str | Column = "vec_id", every: int = 100) -> Column:
    return (F.col(vec_id) if isinstance(vec_id, str) else vec_id) % every == 0


def op12_nearest(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest rows of every row whose vec_id is divisible by 100: query_id, rank, vec_id, score."""
    vectors = embeddings.select("vec_id", "embedding")
    return neighbours(vectors, vectors.where(is_query()))


OP12_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings
 WHERE len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
 FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""
