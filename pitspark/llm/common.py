"""What several operators share: shared-folder tables, size-checked broadcasts and word hashing."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere here are maximal runs of characters other than these six.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side may be broadcast; callers say what a row holds at most.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the cluster names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: What Spark hands to a Python worker at once, while an operator's own tables are written: whole texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def small_batches(spark: SparkSession):
    """Bounds the rows and bytes of Arrow batches of what runs inside; the session's own settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df in small batches to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df, a table that is cheap to count, holds at most ``rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- words of Arrow text

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x + np.uint64((int(salt) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least), so that temporaries stay small."""
    text = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        done = min(max(done, at + 1), len(size))
        yield batch.slice(at, done - at)
        at = done


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: first and last byte (exclusive), text and 64-bit hash of each, in order."""

    def __init__(self, text: pa.Array, lower: bool = False, blank: np.ndarray = _BLANK):
        self.data, self.offsets = utf8(text)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = ~blank[self.data]
        first, last = inside.copy(), inside.copy()
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        #: words of text i: bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, n + 1)[start])


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, modulo 2^64."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
