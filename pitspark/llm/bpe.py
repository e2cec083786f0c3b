"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into matches of the pre-tokenizer's pattern, each encoded by itself.
A match's bytes are halved until single bytes remain; neighbours are joined by
encoding a window around the border anew, which grows until the tokens outside it
provably stay: a row of tokens is the encoding of its bytes if each two neighbours,
encoded together, come out unchanged, so it is enough that the window's first and
last token leave theirs alone. Encodings of short byte strings and the verdicts on
neighbours are remembered, within a bound. Decoding concatenates up the same tree.

Null and empty texts have no tokens. Whole texts are read, however long. Every row is
encoded by itself: repeated rows and ids (null ones too) have a row each, an empty table
gives an empty result, columns of any other name don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

#: Entries that a worker remembers of each kind; the recently used half stays when it is full.
MEMO = 3 << 17
#: Bytes up to which the encoding of a part, of a window and of a whole match is remembered.
PART, WINDOW, MATCH = 5, 12, 64


class Memo(dict):
    """Remembers what ``make`` gives for a key, for the most recent keys at least."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.parts = Memo(lambda data: self.join(*map(self.encode_bytes, (data[: len(data) // 2], data[len(data) // 2 :]))))
        self.pairs = Memo(lambda pair: self.merge(self.token[pair[0]] + self.token[pair[1]]))
        self.windows = Memo(self.merge)
        self.matches = Memo(lambda match: self.encode_bytes(match.encode()))

    def forget(self) -> None:
        """Gives back what was remembered, for whatever the worker does next."""
        for memo in (self.parts, self.pairs, self.windows, self.matches):
            memo.clear()
            memo.old = {}

    def window(self, data: bytes) -> tuple[int, ...]:
        return self.windows[data] if len(data) <= WINDOW else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The lowest-ranked pair is merged first, the leftmost of equals, until none has a rank."""
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        part: list = [data[i : i + 1] for i in range(len(data))]
        after = list(range(1, len(data) + 1))
        before = list(range(-1, len(data) - 1))
        heap = [(r, i) for i in range(len(data) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapify(heap)
        end = len(data)
        while heap:
            rank, i = heappop(heap)
            if part[i] is None or (j := after[i]) == end or ranks.get(part[i] + part[j]) != rank:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                if (r := ranks.get(part[i] + part[after[i]])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heappush(heap, (r, h))
        return tuple(ranks[p] for p in part if p is not None)

    def stays(self, a: int, b: int) -> bool:
        """Whether two tokens, encoded together, come out as they are."""
        return self.pairs[a, b] == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes from their encodings."""
        i = j = 1
        middle = self.pairs[left[-1], right[0]]
        if middle == (left[-1], right[0]):
            return left + right
        while True:
            fits_left = i == len(left) or self.stays(left[-i - 1], middle[0])
            fits_right = j == len(right) or self.stays(middle[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + middle + right[j:]
            if not fits_left:
                i = min(2 * i, len(left))
            if not fits_right:
                j = min(2 * j, len(right))
            middle = self.window(self.decode(left[len(left) - i :] + right[:j]))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        if len(data) == 1:
            return (self.ranks[data],)
        if len(data) <= PART:
            return self.parts[data]
        return self.join(self.encode_bytes(data[: len(data) // 2]), self.encode_bytes(data[len(data) // 2 :]))

    def encode(self, text: str) -> list[int]:
        matches = self.pattern.findall(text)
        if max(map(len, matches), default=0) > MATCH:
            return [i for m in matches for i in (self.matches[m] if len(m) <= MATCH else self.encode_bytes(m.encode()))]
        return list(chain.from_iterable(map(self.matches.__getitem__, matches)))

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column as Python lists (null: empty), made from its flat values at once."""
    flat = np.asarray(column.flatten()).tolist()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


_loaded: dict[tuple[str, str], Bpe] = {}


def tokenizer(vocabulary: str, pattern: str) -> Bpe:
    """The tokenizer of a rank file, which every executor has under this path; read once in a worker."""
    if (vocabulary, pattern) not in _loaded:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary, pattern] = Bpe(ranks, pattern)
    return _loaded[vocabulary, pattern]


def _encode(vocabulary: str, pattern: str):
    """(id, text) to (id, ids)."""

    def run(batches):
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            for piece in pieces(batch):
                ids = [bpe.encode(text) if text else [] for text in piece.column("text").to_pylist()]
                bounds = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=bounds[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, bounds[-1])
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["id", "ids"])
        bpe.forget()

    return run


def _decode(vocabulary: str, pattern: str):
    """(id, ids) to (id, ids, decoded)."""

    def run(batches):
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([bpe.decode(x) for x in _lists(ids)], pa.binary())], names=["id", "ids", "decoded"])

    return run


def _digest(batches):
    """(id, ids, decoded) to the digests."""
    decimal = Memo(str)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = _lists(part.column("ids"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x or b"").hexdigest() for x in part.column("decoded").to_pylist()], pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""
    return _texts(docs, id_col, text_col).mapInArrow(_encode(vocabulary, pattern), "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary) for every row of (id, ids); null ids decode to no bytes."""
    source = encoded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return source.mapInArrow(_decode(vocabulary, pattern), "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of (id, ids, decoded)."""
    source = decoded.select(F.col(id_col).cast("long").alias("id"), "ids", "decoded")
    return source.mapInArrow(_digest, DIGESTS).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of bpe_encode, then bpe_decode, for every row: the three steps in one worker, piece by piece."""
    encode, decode = _encode(vocabulary, pattern), _decode(vocabulary, pattern)
    return cut(_texts(docs, id_col, text_col).mapInArrow(lambda batches: _digest(decode(encode(batches))), DIGESTS), "digests").withColumnRenamed("id", id_col)
