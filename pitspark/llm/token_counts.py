"""Token counts of a piece vocabulary with merges by score and byte fallback, by a whole-token shortcut.

The library puts a word mark before a text and for each blank, and merges the neighbours
whose join is a piece of the best score, the leftmost of equals, until none is left; a
character that is no piece counts as its UTF-8 bytes. Two things are proved from the
vocabulary alone, before any text is read:

1. Where texts may be cut. A merge makes a piece, so two neighbouring characters that
   stand side by side in no piece are never in one token, and the runs of characters
   between such borders, the pre-tokens, are encoded each by itself.
2. Which vocabulary strings encode alone as one token: each is merged from its
   characters once, on the driver, for a better merge may stand in the way of some. The
   proof is a bit for each piece and travels to the tasks.

A pre-token with such a proof counts one; the rest is merged and remembered, within a
bound. Texts are read whole, in windows that end at a border.

Null and empty texts have no tokens and no bytes. Every row is counted by itself: repeated
rows and ids (null ones too) have a row each, an empty table gives an empty result,
columns of any other name don't matter. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import cut, pieces

#: The word mark that stands for a blank.
MARK = "▁"
#: Characters of a text that are looked at together.
WINDOW = 1 << 18
#: Characters up to which a pre-token's count is remembered.
LONG = 256
#: Characters up to which merges look at all pairs; longer runs take a heap.
SHORT = 48
NEVER = float("inf")


class PieceCounter:
    def __init__(self, model: str, proof: bytes | None = None):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(library.get_piece_size())
        own = [i for i in ids if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        #: pieces by score, the best lowest
        self.rank = {library.id_to_piece(i): -library.get_score(i) for i in own}
        chars = sorted({ord(c) for piece in self.rank for c in piece})
        self.index = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.index[chars] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for piece in self.rank:
            at = self.index[[ord(c) for c in piece]]
            self.joined[at[:-1], at[1:]] = True
        if proof is None:
            self.whole = {piece for piece in self.rank if self.merged(piece) == 1}
        else:
            bits = np.unpackbits(np.frombuffer(proof, np.uint8), count=len(self.rank))
            self.whole = {piece for piece, bit in zip(self.rank, bits.tolist()) if bit}
        self.memo = Memo(self.merged)

    def proof(self) -> bytes:
        """A bit for each piece: whether it encodes alone as one token."""
        return np.packbits([piece in self.whole for piece in self.rank]).tobytes()

    def merged(self, run: str) -> int:
        """The number of tokens of a run of characters, by merging."""
        parts = self.short(run) if len(run) <= SHORT else self.long(run)
        rank = self.rank
        return sum([1 if p in rank else len(p.encode()) for p in parts])

    def short(self, run: str) -> list[str]:
        """Merges by looking at all pairs each time."""
        part, get = list(run), self.rank.get
        ranks = [get(a + b, NEVER) for a, b in zip(part, part[1:])]
        while ranks and (r := min(ranks)) < NEVER:
            i = ranks.index(r)
            part[i] += part[i + 1]
            del part[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(part[i] + part[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(part[i - 1] + part[i], NEVER)
        return part

    def long(self, run: str) -> list[str]:
        """Merges by a heap."""
        rank, end = self.rank, len(run)
        part: list = list(run)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i in range(end - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if part[i] is None or (j := after[i]) == end or rank.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                if (r := rank.get(part[i] + part[after[i]])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get(part[h] + part[i])) is not None:
                heappush(heap, (r, h))
        return [p for p in part if p is not None]

    def borders(self, run: str) -> np.ndarray:
        """Places inside a run at which no token can go on."""
        at = self.index[np.frombuffer(run.encode("utf-32-le"), np.uint32)]
        return np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, at, rest, size = 0, 0, MARK, WINDOW
        whole, memo = self.whole, self.memo
        while at < len(text):
            run = rest + text[at : at + size].replace(" ", MARK)
            at += size
            cuts = self.borders(run).tolist()
            if at >= len(text):
                cuts.append(len(run))
            elif not cuts:  # no border in sight: look further
                rest, size = run, 2 * size
                continue
            rest, size = run[cuts[-1] :], WINDOW
            tokens = [run[a:b] for a, b in zip([0, *cuts], cuts)]
            left = [token for token in tokens if token not in whole]
            total += len(tokens) - len(left)
            total += sum(map(memo.__getitem__, left) if max(map(len, left), default=0) <= LONG else (memo[x] if len(x) <= LONG else self.merged(x) for x in left))
        return total


_loaded: dict[str, PieceCounter] = {}


def counter(model: str, proof: bytes | None = None) -> PieceCounter:
    """The counter of a model file, which every executor has under this path; read once in a worker."""
    if model not in _loaded:
        _loaded[model] = PieceCounter(model, proof)
    return _loaded[model]


def _count(model: str, proof: bytes):
    def run(batches):
        count = counter(model, proof).count
        for batch in batches:
            for piece in pieces(batch):
                n = [count(text) if text else 0 for text in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit: n_tokens > limit) for every row."""
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    counted = cut(source.mapInArrow(_count(model, counter(model).proof()), "id long, n_bytes long, n_tokens long"), "counts")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
