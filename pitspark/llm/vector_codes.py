"""Compression of vectors into codes of eight bytes, with LAESA pivots for the nearest entry.

Each vector becomes whole numbers, floor(scale * x), and is cut into equal consecutive
parts. Every part position has a codebook, which starts as that part of the rows with the
smallest ids; in each round every part goes to its nearest entry and every entry to the
floor of its parts' mean; entries without parts stay.

The search for the nearest entry: the distances of each part to a few fixed pivots of its
position, the spread entries of the first codebook, are computed once and written down
beside the vectors. In a round only the entries' distances to the same pivots are new;
|d(part, pivot) - d(entry, pivot)| at the pivot that parts them most is a lower bound of
d(part, entry). Entries are taken by ascending bound, squared distances are evaluated in
whole numbers, and an entry is left out when its bound, less what rounding may add, is
above the least distance so far. Ties go to the lower index, so an entry whose bound
equals that distance is still evaluated.

A round is one pass over the written rows; a task returns one sum for each entry and
component, Spark adds them up, and the driver takes in one codebook (entries x components,
whatever the number of rows).

Vectors that are null, empty or hold null or non-finite components take no part. Rows
without an id count as the last by id. Vectors of unequal length are filled up with zeros,
up to a multiple of the parts. Rows with equal ids go by their vectors; repeated rows have a row
each. With fewer rows than entries there are as many entries as rows. Components beyond
``PLAIN`` are computed with whole numbers of any size, without bounds; errors are 64-bit
integers and those beyond count as the greatest. An empty table gives an empty result,
columns of any other name don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Pivots of a position.
PIVOTS = 4
#: Up to this absolute value a component is plain: squared distances of up to 4,096 components are exact in 64-bit integers and doubles.
PLAIN, PLAIN_DIMS = 1 << 19, 1 << 12
#: What rounding may take from a bound, relative to the distances it comes from (stored in single precision).
SLACK = 2.0**-21
#: Sums of whole numbers of any size travel in limbs of so many bits.
LIMB = 40
MOST = (1 << 63) - 1


def whole_parts(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles that hold whole numbers exactly; null if the vector takes no part."""
    value = lambda x: x.cast("double") * scale
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(value(x)) < float("inf")))
    # beyond 2^52 a double is whole
    whole = F.transform(vector, lambda x: F.when(F.abs(value(x)) < 2.0**52, F.floor(F.when(F.abs(value(x)) < 2.0**52, value(x))).cast("double")).otherwise(value(x)))
    return F.when(finite & (F.size(vector) > 0), whole)


def _numbers(column: pa.ListArray, dims: int) -> np.ndarray:
    """The vectors as rows of whole numbers of one length: 64-bit ones, or Python's where they are not plain."""
    flat, n = np.asarray(column.flatten()), len(column)
    size = np.diff(np.asarray(column.offsets))
    plain = dims <= PLAIN_DIMS and (not len(flat) or float(np.abs(flat).max()) <= PLAIN)
    out = np.zeros((n, dims), np.int64 if plain else object)
    if len(flat) == n * dims:
        out[:] = flat.astype(np.int64).reshape(n, dims) if plain else np.array([int(x) for x in flat.tolist()], object).reshape(n, dims)
    else:
        at = np.concatenate([[0], np.cumsum(size)])
        for i in range(n):
            row = flat[at[i] : at[i + 1]]
            out[i, : size[i]] = row.astype(np.int64) if plain else [int(x) for x in row.tolist()]
    return out


@dataclass
class Codebooks:
    """entries: (part, entry, component) whole numbers; pivots: the same for the fixed pivots."""

    entries: np.ndarray
    pivots: np.ndarray
    evaluated: int = 0  # squared distances, of ``possible``
    possible: int = 0

    @property
    def plain(self) -> bool:
        return self.entries.dtype != object

    def pivot_distances(self, rows: np.ndarray) -> np.ndarray:
        """(row, part, pivot) distances in single precision."""
        parts = rows.reshape(len(rows), len(self.pivots), -1)
        out = np.zeros((len(rows), *self.pivots.shape[:2]), np.float32)
        if rows.dtype != object and self.plain:
            for k in range(self.pivots.shape[1]):
                out[:, :, k] = np.sqrt((np.square(parts - self.pivots[None, :, k])).sum(2).astype(np.float64))
        return out

    def nearest(self, rows: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, (row, part) each; far: the rows' pivot distances."""
        n_parts, n_entries = self.entries.shape[:2]
        parts = rows.reshape(len(rows), n_parts, -1)
        if rows.dtype == object or not self.plain:
            wide = parts.astype(object)
            squares = np.stack([np.square(wide - self.entries.astype(object)[None, :, e]).sum(2) for e in range(n_entries)], 2)
            at = np.array([[min(range(n_entries), key=row.__getitem__) for row in rows_] for rows_ in squares]).reshape(len(rows), n_parts)
            return at, np.take_along_axis(squares, at[:, :, None], 2)[:, :, 0]
        index, least = np.zeros((len(rows), n_parts), np.int64), np.zeros((len(rows), n_parts), np.int64)
        for p in range(n_parts):
            x, entries = parts[:, p], self.entries[p]
            away = np.sqrt(np.square(entries[:, None] - self.pivots[p][None]).sum(2).astype(np.float64))  # (entry, pivot)
            bound = np.zeros((len(x), n_entries))
            for k in range(away.shape[1]):
                d = far[:, p, k].astype(np.float64)[:, None]
                np.maximum(bound, np.abs(d - away[None, :, k]) - SLACK * (d + away[None, :, k]), out=bound)
            order = np.argsort(bound, axis=1, kind="stable")
            ranked = np.square(np.take_along_axis(bound, order, 1))
            best, where = np.full(len(x), MOST, np.int64), np.full(len(x), n_entries, np.int64)
            todo = np.arange(len(x))
            for r in range(n_entries):
                todo = todo[ranked[todo, r] <= best[todo]]  # bounds ascend: who is done stays done
                if not len(todo):
                    break
                e = order[todo, r]
                square = np.square(x[todo] - entries[e]).sum(1)
                self.evaluated += len(todo)
                better = (square < best[todo]) | ((square == best[todo]) & (e < where[todo]))
                best[todo[better]], where[todo[better]] = square[better], e[better]
            self.possible += len(x) * n_entries
            index[:, p], least[:, p] = where, best
        return index, least


def _limbs(x: int) -> list[int]:
    """x as limbs, the lowest first; all but the last are not negative."""
    out = []
    while not -(1 << 62) < x < 1 << 62:
        x, low = divmod(x, 1 << LIMB)
        out.append(low)
    return [*out, x]


def _batches(batches, dims: int):
    """(batch, rows, pivot distances) in slices that keep temporaries small."""
    for batch in batches:
        step = max(1, (1 << 18) // dims)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows = _numbers(part.column("v"), dims)
            yield part, rows


def _far(part: pa.RecordBatch, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("far").to_pylist()), np.float32).reshape(shape)


def _described(books: Codebooks, dims: int):
    """(id, label, v) with the distances to the pivots."""

    def run(batches):
        for part, rows in _batches(batches, dims):
            far = [x.tobytes() for x in books.pivot_distances(rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "v")), pa.array(far, pa.binary())], names=["id", "label", "v", "far"])

    return run


SUMS = "place long, limb int, total decimal(38,0)"


def _sums(books: Codebooks, dims: int):
    """One task's sums: (place, limb, total) with place = (part, entry, component or the count)."""

    def run(batches):
        n_parts, n_entries, width = books.entries.shape
        sums: dict[tuple[int, int], int] = {}
        for part, rows in _batches(batches, dims):
            index, _ = books.nearest(rows, _far(part, (len(rows), *books.pivots.shape[:2])))
            parts = rows.reshape(len(rows), n_parts, width)
            for p in range(n_parts):
                for e in np.unique(index[:, p]).tolist():
                    mine = parts[index[:, p] == e, p]
                    for c, total in enumerate([*mine.sum(0).tolist(), len(mine)]):
                        key = (p * n_entries + e) * (width + 1) + c
                        for limb, x in enumerate(_limbs(int(total))):
                            sums[key, limb] = sums.get((key, limb), 0) + x
        places = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in places], pa.int64()), pa.array([x[1] for x in places], pa.int32()), pa.array([sums[x] for x in places], pa.decimal128(38, 0))],
            names=["place", "limb", "total"],
        )

    return run


def _coded(books: Codebooks, dims: int):
    """(id, label, code, error)."""

    def run(batches):
        for part, rows in _batches(batches, dims):
            index, least = books.nearest(rows, _far(part, (len(rows), *books.pivots.shape[:2])))
            code = [x.tobytes().hex() for x in index.astype(np.uint8)]
            error = [min(int(x), MOST) for x in least.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return run


def _tight(entries: np.ndarray) -> np.ndarray:
    """64-bit numbers if all entries are plain."""
    return entries.astype(np.int64) if all(abs(x) <= PLAIN for x in entries.ravel().tolist()) else entries


def first_codebooks(kept: DataFrame, parts: int, entries: int, dims: int) -> Codebooks:
    """The parts of the rows with the smallest ids; of these the pivots, spread over the codebook."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # a row for each entry
    rows = _numbers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims)
    books = rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)
    pivots = books[:, np.unique(np.linspace(0, len(rows) - 1, PIVOTS).round().astype(int))]
    return Codebooks(books, pivots)


def next_codebooks(books: Codebooks, sums: list) -> Codebooks:
    """The floor of each entry's mean; an entry without parts stays."""
    n_parts, n_entries, width = books.entries.shape
    total: dict[int, int] = {}
    for place, limb, x in sums:
        total[place] = total.get(place, 0) + (int(x) << (LIMB * limb))
    entries = books.entries.astype(object)
    for p in range(n_parts):
        for e in range(n_entries):
            at = (p * n_entries + e) * (width + 1)
            if count := total.get(at + width, 0):
                entries[p, e] = [total[at + c] // count for c in range(width)]
    return Codebooks(_tight(entries), books.pivots)


def learn_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks, DataFrame, int]:
    """The codebooks after all rounds, the written rows (id, label, v, far) and their number of components."""
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole_parts(F.col(vector_col), scale).alias("v")).where("v is not null")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    if not dims:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0, 0), np.int64)), kept.withColumn("far", F.lit(b"")), 0
    books = first_codebooks(kept, parts, entries, dims)
    kind = kept.schema["label"].dataType.simpleString()
    rows = cut(kept.mapInArrow(_described(books, dims), f"id long, label {kind}, v array<double>, far binary"), "parts")
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(books, dims), SUMS).groupBy("place", "limb").agg(F.sum("total").alias("total"))
        books = next_codebooks(books, sums.collect())  # a row for each component of each entry
    return books, rows, dims


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each row that takes part.

    code: two hex digits for each part; error: squared distance to the coded vector; label_error: its sum over the rows of
    the label (rows without one together).
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: entries must be from 1 to 256")
    books, rows, dims = learn_codebooks(vectors, id_col, vector_col, label_col, parts, entries, rounds, scale)
    kind = rows.schema["label"].dataType.simpleString()
    coded = cut(rows.mapInArrow(_coded(books, max(dims, 1)), f"id long, label {kind}, code string, error long"), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = small(cut(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
