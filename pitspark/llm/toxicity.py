"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words (runs of ASCII letters, digits and non-ASCII
characters, A-Z lower-cased) and, so that inflected or made-up forms of a stem count
too, the first four and five bytes of longer words, hashed into ``2 ** BITS`` buckets.
The machine adds a weight for each feature and, for each pair of features, the inner
product of their vectors: an insult next to a mention of a group can weigh more than
both alone. Pairs are scaled by the number of features, so long texts don't drown.

It is fitted by mini-batches with adaptive steps on at most ``SAMPLE`` labelled rows
(the first in the order of a hash of the id, so the bound does not depend on the
table), in one task; both classes weigh the same, and weights that little depends on shrink to
nothing. Its parameters have a fixed size and go to every executor;
scoring reads every whole text. Buckets in fewer than ``LEAST_TEXTS`` of the fitted texts, or
in less than ``LEAST_SHARE`` of them (24 of 12,000), stay without weight: they are learnt by
heart otherwise.

Labels are learnt only from rows that the caller does not hold out. Null and empty
texts have no features and get the score of the bias alone. Labels that are null or
whose text is missing are not used; with none, every score is 0. An id stands for one
labelled row: of several labels the greatest counts, of several texts the least. Every row
is scored by itself, repeated ones alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, pieces, span_hashes

BITS, FACTORS = 18, 8
SAMPLE, LEAST_TEXTS, LEAST_SHARE = 12_000, 3, 0.002
#: Passes over the fitted rows (more of them where rows are few), rows in a step, its size, and what shrinks weights.
EPOCHS, LEAST_STEPS, BATCH, STEP, START = 8, 300, 128, 0.3, 0.1
SHRINK, DECAY = 2e-3, 1e-5

_APART = np.zeros(256, bool)
_APART[:128] = [not chr(i).isalnum() for i in range(128)]


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text, and the bounds of each text's."""
    words = Words(text, lower=True, blank=_APART)
    bucket, doc = [mix(words.hashes(), 1)], [words.doc]
    for n in (4, 5):
        long = words.end - words.start > n
        bucket.append(mix(span_hashes(words.data, words.start[long], words.start[long] + n), n))
        doc.append(words.doc[long])
    key = (np.concatenate(doc).astype(np.int64) << BITS) | (np.concatenate(bucket) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(text) + 1))


class Machine:
    def __init__(self, bias: float = -50.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.bias = bias
        self.w = np.zeros(1 << BITS, np.float32) if w is None else w
        self.v = np.zeros((1 << BITS, FACTORS), np.float32) if v is None else v

    def pack(self) -> bytes:
        return np.float64(self.bias).tobytes() + self.w.tobytes() + self.v.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        w = np.frombuffer(data, np.float32, 1 << BITS, 8)
        v = np.frombuffer(data, np.float32, -1, 8 + 4 * len(w)).reshape(-1, FACTORS)
        return cls(float(np.frombuffer(data, np.float64, 1)[0]), w, v)

    def logits(self, bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(bounds), 1)
        v = self.v[bucket]
        own = _sums((v * v).sum(1), bounds)
        return self.bias + _sums(self.w[bucket], bounds) + ((_sums(v, bounds) ** 2).sum(1) - own) / (2 * n)

    def scores(self, text: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(text)), -500, 500)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Machine:
    if not len(y):
        return Machine()
    random = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    least = max(LEAST_TEXTS, int(LEAST_SHARE * len(y)))
    rows = [r[seen[r] >= least] for r in rows]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weigh = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
    m = Machine(0.0)
    m.v = random.normal(0, 0.05, m.v.shape).astype(np.float32)
    m.v[seen < least] = 0
    gw, gv, gb = np.full(len(m.w), START, np.float32), np.full(m.v.shape, START, np.float32), START
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(y))):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            size = np.array([len(rows[i]) for i in pick])
            bounds = np.concatenate([[0], np.cumsum(size)])
            bucket = np.concatenate([rows[i] for i in pick])
            z = m.logits(bucket, bounds)
            g = (weigh[pick] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[pick]) / len(pick)).astype(np.float32)
            gb += float(g.sum()) ** 2
            m.bias -= STEP * float(g.sum()) / gb**0.5
            if not len(bucket):
                continue
            used, to = np.unique(bucket, return_inverse=True)
            each = np.repeat(g, size)
            dw = np.bincount(to, each, len(used)).astype(np.float32)
            gw[used] += dw * dw
            rate = STEP / np.sqrt(gw[used])
            w = m.w[used] - rate * dw
            m.w[used] = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK, 0)
            v = m.v[bucket]
            pull = (np.repeat(_sums(v, bounds), size, axis=0) - v) * (each / np.repeat(np.maximum(size, 1), size))[:, None]
            dv = np.stack([np.bincount(to, pull[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * m.v[used]
            gv[used] += dv * dv
            m.v[used] -= STEP * dv / np.sqrt(gv[used])
    return m


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fits a machine on labelled rows; leave out of ``labels`` what is held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = cut(known.orderBy(F.xxhash64(id_col), id_col).limit(sample), "sample").withColumnRenamed(id_col, "_id")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "y").agg(F.min("text").alias("text"))
    rows = rows.select("y", F.xxhash64("_id").alias("at"), "text")

    def describe(batches):
        for batch in batches:
            for piece in pieces(batch):
                bucket, bounds = features(piece.column("text"))
                packed = [bucket[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("at"), piece.column("y"), pa.array(packed, pa.binary())], names=["at", "y", "x"])

    def train(batches):
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        machine = fit([np.frombuffer(x, np.int32) for _, _, x in rows], np.array([y for _, y, _ in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.pack()], pa.binary())], names=["machine"])

    described = rows.mapInArrow(describe, "at long, y int, x binary")
    return Machine.unpack(described.repartition(1).mapInArrow(train, "machine binary").first()[0])


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    packed = docs.sparkSession.sparkContext.broadcast(machine.pack())

    def run(batches):
        m = Machine.unpack(packed.value)
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(m.scores(piece.column("text")))], names=["id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(source.mapInArrow(run, "id long, score double"), "scores").withColumnRenamed("id", id_col)
