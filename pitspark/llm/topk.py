"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x). Rows are dealt into blocks by a hash; each
block is an index of its own: for every dimension, its rows in posting segments by
quantised value. A query visits the segments of all dimensions by descending
quantised impact (the most that a posting of the segment adds to a score, above the
least that its dimension adds to any) and adds the impact to its rows. From the
impacts that can still come, every row has a proven upper bound, and a lower bound
from the width of a segment. Visiting stops once few rows can still be among the k
best; those are scored exactly from their vectors. If that never happens, all
segments are visited, which gives the same result.

The query set meets every block, in chunks: a task holds one block and one chunk. A
block returns k rows a query at most and the best k of all blocks stay. Ties go to the
smaller id. Rows that agree in id and vector are searched as one and returned as often as
they occur, up to k times.

Vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without an id. An id stands for one row: rows with the query's id are its own.
Vectors of unequal length are filled up with zeros. Components beyond ``PLAIN`` are scored
with whole numbers of any size, not by the index; scores are 64-bit integers, and those
beyond count as the greatest or the least of these. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_ROWS, CHUNK_QUERIES, LEVELS = 16_384, 4_096, 16
#: Up to these components, and so many of them, sums of products are exact in 64-bit floating point.
PLAIN, PLAIN_DIMS = 1 << 20, 1 << 12
#: Visiting may stop once so many rows, or this share of a block, are left to score.
LEFT_ROWS, LEFT_SHARE = 64, 0.02
#: Shares of the segments after which the proof is tried.
PROOFS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """The vector of whole numbers, as doubles that hold them exactly; null if it takes no part."""
    value = lambda x: x.cast("double") * scale
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(value(x)) < float("inf")))
    # beyond 2^52 a double is whole
    whole = F.transform(vector, lambda x: F.when(F.abs(value(x)) < 2.0**52, F.floor(F.when(F.abs(value(x)) < 2.0**52, value(x))).cast("double")).otherwise(value(x)))
    return F.when(finite & (F.size(vector) > 0), whole)


class Index:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        self.ids, self.rows = ids, rows
        self.visited = self.segments = 0  # of all queries
        self.low, self.high = rows.min(0), rows.max(0)
        self.width = (self.high - self.low) // levels + 1
        level = (rows - self.low) // self.width
        n, dims = rows.shape
        self.posting = np.empty((dims, n), np.int32)
        self.begin = np.empty((dims, levels + 1), np.int64)
        for d in range(dims):
            self.posting[d] = np.argsort(level[:, d], kind="stable")
            self.begin[d] = np.searchsorted(level[self.posting[d], d], np.arange(levels + 1))
        first = self.low[:, None] + np.arange(levels) * self.width[:, None]
        self.first, self.last = np.minimum(first, self.high[:, None]), np.minimum(first + self.width[:, None] - 1, self.high[:, None])

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, scores and places of the k best rows but the query's own."""
        n, dims = self.rows.shape
        q = np.pad(q, (0, max(0, dims - len(q))))[:dims]
        a, b = q[:, None] * self.first, q[:, None] * self.last
        least = np.minimum(q * self.low, q * self.high)
        impact = (np.maximum(a, b) - least[:, None]).astype(np.float64)
        size = np.diff(self.begin, axis=1)
        impact[size == 0] = -1
        order = np.argsort(-impact, axis=None, kind="stable")[: int((size > 0).sum())]
        error = float((np.abs(q) * (self.width - 1)).sum())
        got, seen = np.zeros(n), np.zeros(n, np.int64)
        got[self.ids == own] = -np.inf
        left = np.sort(impact, axis=1)[:, ::-1]  # of each dimension, what its segments still bring
        used = np.zeros(dims, np.int64)
        proofs = {int(len(order) * p) for p in PROOFS} | {len(order)}
        levels = impact.shape[1]
        flat = impact.ravel()
        for i, segment in enumerate(order, 1):
            d, l = divmod(int(segment), levels)
            at = self.posting[d, self.begin[d, l] : self.begin[d, l + 1]]
            got[at] += flat[segment]
            seen[at] += 1
            used[d] += 1
            if i in proofs:
                rest = np.where(used < levels, left[np.arange(dims), np.minimum(used, levels - 1)], 0).clip(0)
                may = np.concatenate([[0], np.cumsum(np.sort(rest)[::-1])])  # the most that so many unseen dimensions bring
                most = got + may[dims - seen]
                kth = np.partition(got, n - k)[n - k] - error if n >= k else -np.inf
                some = np.flatnonzero((most >= kth) & (got > -np.inf))
                if len(some) <= max(LEFT_ROWS, LEFT_SHARE * n) or i == len(order):
                    break
        self.visited, self.segments = self.visited + i, self.segments + len(order)
        score = self.rows[some] @ q
        best = np.lexsort((self.ids[some], -score))[:k]
        return self.ids[some][best], score[best], some[best]


def _stack(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat, bounds = np.asarray(column.values), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _plain(v: np.ndarray) -> bool:
    return len(v) <= PLAIN_DIMS and bool((np.abs(v) <= PLAIN).all())


def _product(a: np.ndarray, b: np.ndarray) -> int:
    """The exact inner product, cut to 64 bits."""
    return max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, b))))


class Block:
    """An index of the rows (id, times, vector) with plain components, and the others beside it."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.rows, self.plain = rows, [r for r in rows if _plain(r[2])]
        self.index = Index(np.array([r[0] for r in self.plain]), _stack([r[2] for r in self.plain])) if self.plain else None
        self.others = [r for r in rows if not _plain(r[2])]

    def search(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(score, id, times) of the k best rows but the query's own."""
        fast = self.index is not None and _plain(q)
        found = [(int(s), int(i), self.plain[at][1]) for i, s, at in zip(*self.index.search(own, q.astype(np.int64), k))] if fast else []
        found += [(_product(q, v), i, n) for i, n, v in (self.others if fast else self.rows) if i != own]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


FOUND = "query_id long, vec_id long, score long, n long"


def _search(k: int):
    """Rows (block, chunk, asks, id, n, vector) come sorted, the block's own first."""

    def run(batches):
        task, block, held = None, None, []
        for batch in batches:
            found: list[tuple] = []
            for b, c, asks, i, n, vector in zip(*(x.to_pylist() for x in batch.columns[:5]), _vectors(batch.column(5))):
                if (b, c) != task:
                    task, block, held = (b, c), None, []
                if not asks:
                    held.append((i, n, vector))
                    continue
                if block is None and held:
                    block = Block(held)
                if block is not None:
                    found += [(i, vec, score, times) for score, vec, times in block.search(i, vector, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(4)], names=["query_id", "vec_id", "score", "n"])

    return run


def _dealt(df: DataFrame, other: str, n: int) -> DataFrame:
    """Every row once for each of n blocks or chunks of the other side."""
    return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each id in queries."""

    def numbers(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")

    every = cut(numbers(vectors).groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("n")), "vectors")
    asked = cut(numbers(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks, chunks = max(1, -(-every.count() // block_rows)), max(1, -(-asked.count() // chunk_queries))
    data = _dealt(every.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))), "chunk", chunks)
    asks = _dealt(asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))), "block", blocks)
    rows = data.select("block", "chunk", F.lit(False).alias("asks"), "id", "n", "v")
    rows = rows.unionByName(asks.select("block", "chunk", F.lit(True).alias("asks"), "id", F.lit(1).cast("long").alias("n"), "v"))
    found = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks").mapInArrow(_search(k), FOUND)
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
