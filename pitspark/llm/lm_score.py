"""Masked pseudo-likelihood of texts under a bidirectional window network.

Words are tokens: the ``COMMON`` most frequent words of the corpus (counted over all
texts) have one each, all others share ``RARE`` tokens by hash. A small network predicts
each token from two tokens on either side: their embeddings pass a tanh layer, which
gives the token's class and, within it, the token (two softmaxes of the square root of
the vocabulary each). Within a shared token, a word has its share of the corpus'
counts, and words that the corpus does not have count as one word that occurs once. A
text's score is the sum over its words of the log probability given both sides, each
masked in its turn.

Texts are turned into token numbers once, in a table. The counts of all words stay a
table too. Those from a frequency on, as many as fit in ``NEAR``, are sent to the tasks;
the other words of the texts are joined to the table.

The network is trained in numpy where the data lies. Texts are dealt by a hash of what
they hold into units of about ``UNIT_TOKENS`` tokens, in the order of that hash. In each
of ``ROUNDS`` rounds every unit is gone through from the current weights, learning from
every ``ROUNDS``-th position, others each round, so that all rounds learn from every
position once; the units' weights and step sizes are averaged by their positions, up a
tree of ``FAN`` units a step, in the order of their numbers. So the weights depend on the
rows of the table only, not on its files, partitions or tasks (scores do up to rounding
in single precision). The driver sees the frequent words,
how many words have each frequency, and the averaged weights only.

Null and blank texts have no tokens and score 0. Every row is scored by itself, equal
texts alike; repeated and null ids have a row each. Columns of any other name don't
matter. With no words at all nothing is learnt; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, per_text, pieces

SIDE = 64
SIZE = SIDE * SIDE  # tokens, classes times members
RARE = 128
COMMON = SIZE - RARE - 1  # the last token is the empty place beyond a text's ends
AROUND, WIDTH, HIDDEN = 2, 16, 16
ROUNDS = 4
#: Words whose counts are sent to the tasks, 16 bytes each; the counts of others are joined.
NEAR = 1 << 17
#: Logarithms of counts are added up as whole numbers of this part, in any order alike.
PART = 2.0**-32
BATCH, STEP = 4096, 0.05
CHUNK = 1 << 15
#: Tokens of a unit that is learnt from in a row; longer ones are cut at a text's end. Units that are averaged at once.
UNIT_TOKENS, FAN = 1 << 21, 64
PIECE = 4096  # weights in a row when they are averaged

#: The last row of class and member is what they add to every position.
SHAPES = {
    "embed": (SIZE, WIDTH), "inner": (2 * AROUND * WIDTH, HIDDEN), "inner_b": (HIDDEN,),
    "class": (HIDDEN + 1, SIDE), "member": (SIDE, HIDDEN + 1, SIDE),
}


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        self.w: dict[str, np.ndarray] = {}
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.w[name] = flat[at : at + n].reshape(shape)
            at += n

    @staticmethod
    def size() -> int:
        return sum(int(np.prod(s)) for s in SHAPES.values())

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        flat = np.zeros(cls.size(), np.float32)
        net, random = cls(flat), np.random.default_rng(seed)
        for name in ("embed", "inner"):
            net.w[name][:] = random.normal(0, 0.2, SHAPES[name])
        return net

    def forward(self, context: np.ndarray, target: np.ndarray):
        """Of positions in the order of their class: inputs, hidden values with a 1, where each class begins, and how likely each class and each member of the target's class are, with their sums."""
        n = len(target)
        x = self.w["embed"][context].reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), x.dtype)
        np.tanh(x @ self.w["inner"] + self.w["inner_b"], out=h[:, :HIDDEN])
        begin = np.searchsorted(target // SIDE, np.arange(SIDE + 1)).tolist()
        members = np.empty((n, SIDE), x.dtype)
        for c in range(SIDE):
            if begin[c] < begin[c + 1]:
                np.matmul(h[begin[c] : begin[c + 1]], self.w["member"][c], out=members[begin[c] : begin[c + 1]])
        classes = h @ self.w["class"]
        for z in (classes, members):
            # hidden values are in [-1, 1] and weights stay small: far from what exp can't hold
            np.exp(np.clip(z, -80, 80, out=z), out=z)
        one = np.ones(SIDE, x.dtype)
        return x, h, begin, classes, members, classes @ one, members @ one

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort((target // SIDE).astype(np.uint16), kind="stable")
        kind, member = np.divmod(target[order], SIDE)
        _, _, _, classes, members, all_classes, all_members = self.forward(context[order], target[order])
        every, out = np.arange(len(target)), np.empty(len(target))
        out[order] = np.log(classes[every, kind] / all_classes) + np.log(members[every, member] / all_members)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort((target // SIDE).astype(np.uint16), kind="stable")
        context, target = context[order], target[order]
        n, every = len(target), np.arange(len(target))
        kind, member = np.divmod(target, SIDE)
        g = Network(np.zeros(self.size(), self.flat.dtype))
        x, h, begin, classes, members, all_classes, all_members = self.forward(context, target)
        classes /= (all_classes * n)[:, None]
        classes[every, kind] -= 1 / n
        members /= (all_members * n)[:, None]
        members[every, member] -= 1 / n
        np.matmul(h.T, classes, out=g.w["class"])
        dh, part = classes @ self.w["class"][:HIDDEN].T, np.empty((n, HIDDEN), x.dtype)
        for c in range(SIDE):
            a, b = begin[c], begin[c + 1]
            if a < b:
                np.matmul(h[a:b].T, members[a:b], out=g.w["member"][c])
                np.matmul(members[a:b], self.w["member"][c, :HIDDEN].T, out=part[a:b])
        dh += part
        dh *= 1 - h[:, :HIDDEN] * h[:, :HIDDEN]
        np.matmul(x.T, dh, out=g.w["inner"])
        g.w["inner_b"][:] = dh.sum(0)
        dx = (dh @ self.w["inner"].T).reshape(-1, WIDTH)
        to = context.ravel().astype(np.uint16)
        order = np.argsort(to, kind="stable")
        used, first = np.unique(to[order], return_index=True)
        g.w["embed"][used] = np.add.reduceat(dx[order], first)
        return g.flat


def tokens(h: np.ndarray, known: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Token numbers of words' hashes; known: sorted hashes, token: their numbers."""
    rare = COMMON + (h % np.uint64(RARE)).astype(np.int64)
    if not len(known):
        return rare
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, token[at], rare)


class Counts(NamedTuple):
    """How often words occur: sorted hashes and log counts of frequent ones, the table (word, n) of the others that occur twice or more, and the log count of each shared token, with one for words not seen."""

    near: np.ndarray
    log_n: np.ndarray
    far: DataFrame
    shared: np.ndarray


def vocabulary(source: DataFrame) -> tuple[np.ndarray, np.ndarray, Counts]:
    """The most frequent words' hashes, sorted, their tokens (0: most frequent), and the counts of all words."""

    def run(batches):
        for batch in batches:
            all_h = []
            for piece in pieces(batch):
                h, n = np.unique(Words(piece.column("text"), lower=True).hashes(), return_counts=True)
                all_h.append((h, n))
            if all_h:
                h, to = np.unique(np.concatenate([h for h, _ in all_h]), return_inverse=True)
                n = np.bincount(to, np.concatenate([n for _, n in all_h]), len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = cut(source.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = np.array([r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()], np.int64)
    # frequencies, of which there are about as many as the root of the number of words
    least, room = 2, NEAR
    for row in counts.where("n > 1").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        room -= row["words"]
        if room < 0:
            least = row["n"] + 1
            break
    near = np.array([tuple(r) for r in counts.where(F.col("n") >= least).collect()], np.int64).reshape(-1, 2)
    near = near[np.argsort(near[:, 0].view(np.uint64))]
    total = np.zeros(RARE, np.int64)
    for row in counts.groupBy(F.col("word").bitwiseAND(RARE - 1).alias("token")).agg(F.sum("n").alias("n")).collect():
        total[row["token"]] = row["n"]
    for row in counts.where(F.col("word").isin(top.tolist())).collect() if len(top) else []:
        total[row["word"] & (RARE - 1)] -= row["n"]
    far = counts.where((F.col("n") > 1) & (F.col("n") < least))
    known = top.view(np.uint64)
    order = np.argsort(known)
    return known[order], order.astype(np.int64), Counts(near[:, 0].copy().view(np.uint64), np.log(near[:, 1]), far, np.log1p(total))


def padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with the empty place AROUND times on either side of each text, and where each token is."""
    at = np.arange(len(ids)) + AROUND * (1 + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
    out = np.full(len(ids) + AROUND * len(bounds), SIZE - 1, np.uint16)
    out[at] = ids
    return out, at


def contexts(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens around places of a padded row."""
    return np.stack([row[at + step] for step in (*range(-AROUND, 0), *range(1, AROUND + 1))], 1)


# ---------------------------------------------------------------- tokens of the corpus

TOKENS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("deal", pa.int64()), ("near", pa.int64()), ("ids", pa.binary()), ("far", pa.binary())])


def tokenised(source: DataFrame, known: np.ndarray, token: np.ndarray, counts: Counts) -> DataFrame:
    """Each text's tokens (two bytes each), the summed log counts of its rarer words that are sent along, and the others' hashes."""
    shared = source.sparkSession.sparkContext.broadcast((known, token, counts.near, counts.log_n))

    def run(batches):
        known, token, near, log_n = shared.value
        row, parts = TaskContext.get().partitionId() << 40, np.rint(log_n / PART).astype(np.int64)
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column("text"), lower=True)
                h, n = words.hashes(), len(piece)
                ids = tokens(h, known, token)
                rare = np.flatnonzero((ids >= COMMON) & (ids < COMMON + RARE))
                seldom, doc = h[rare], words.doc[rare]
                add, here = np.zeros(len(ids), np.int64), np.zeros(len(rare), bool)
                if len(near):
                    at = np.minimum(np.searchsorted(near, seldom), len(near) - 1)
                    here = near[at] == seldom
                    add[rare[here]] = parts[at[here]]
                far, begin = seldom[~here], np.searchsorted(doc[~here], np.arange(n + 1))
                place = np.arange(len(ids)) - words.bounds[words.doc]
                deal = mix(per_text(mix(h + place.astype(np.uint64), 6), words.bounds), 7)
                ids = ids.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), piece.column("id"), pa.array(np.diff(words.bounds), pa.int64()), pa.array(deal.view(np.int64)), pa.array(per_text(add, words.bounds)),
                    pa.array([ids[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:])], pa.binary()),
                    pa.array([far[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary()),
                ], schema=TOKENS)
                row += n

    return cut(source.select("id", "text").mapInArrow(run, "row long, id long, n_tokens long, deal long, near long, ids binary, far binary"), "tokens")


UNITS = pa.schema([("unit", pa.int64()), ("ids", pa.binary()), ("bounds", pa.binary())])


def _pack(dealt: int):
    """Rows (unit, ids) come sorted: a row for each unit, or more where it is too long."""

    def run(batches):
        unit, again, held, size = None, 0, [], 0

        def out():
            bounds = np.concatenate([[0], np.cumsum([len(x) // 2 for x in held])]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([unit + again * dealt]), pa.array([b"".join(held)], pa.binary()), pa.array([bounds.tobytes()], pa.binary())], schema=UNITS)

        for batch in batches:
            for u, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (u != unit or size >= 4 * UNIT_TOKENS):
                    yield out()
                    again, held, size = again + 1 if u == unit else 0, [], 0
                unit = u
                held.append(ids)
                size += len(ids) // 2
        if held:
            yield out()

    return run


def units(rows: DataFrame) -> DataFrame:
    """The corpus as (unit, ids, bounds), dealt by what the texts hold."""
    dealt = max(1, -(-(rows.agg(F.sum("n_tokens")).first()[0] or 0) // UNIT_TOKENS))
    rows = rows.where("n_tokens > 0").select(F.pmod(F.xxhash64("deal", "id"), F.lit(dealt)).alias("unit"), "deal", "ids")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "deal", "ids").select("unit", "ids")
    return cut(rows.mapInArrow(_pack(dealt), "unit long, ids binary, bounds binary"), "units")


# ---------------------------------------------------------------- training


def learn(state: np.ndarray, ids: np.ndarray, bounds: np.ndarray, round_: int) -> tuple[np.ndarray, int]:
    """Weights and squared steps after going through a unit, and from how many positions was learnt."""
    weights, speed = np.array(state, np.float32)
    net = Network(weights)
    row, at = padded(ids, bounds)
    at = at[round_::ROUNDS]
    for i in range(0, len(at), BATCH):
        some = at[i : i + BATCH]
        g = net.gradient(contexts(row, some), row[some].astype(np.int64))
        speed += g * g
        weights -= STEP * g / np.sqrt(speed)
    return np.stack([weights, speed]), len(at)


SUMS = "part int, unit long, n long, sum binary"


def _add(first: bool):
    """The sums of a part's weights over some units, in their order, and of their positions; first: what comes is single precision, each unit's weights."""

    def run(rows):
        rows = rows.sort_values("unit")
        total = np.zeros(len(rows["sum"].iloc[0]) // (4 if first else 8))
        for x, n in zip(rows["sum"], rows["n"]):
            total += np.frombuffer(x, np.float32) * float(n) if first else np.frombuffer(x)
        return rows.head(1).assign(unit=rows["unit"].iloc[0] // FAN, n=rows["n"].sum(), sum=[total.tobytes()])

    return run


def train(corpus: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from the units of a corpus."""
    spark = corpus.sparkSession
    fresh = Network.fresh().flat
    state = np.stack([fresh, np.full(len(fresh), 1e-6, np.float32)])
    last = corpus.agg(F.max("unit")).first()[0]
    if last is None:
        return fresh
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def run(batches, shared=shared, r=r):
            for batch in batches:
                for unit, ids, bounds in zip(*(c.to_pylist() for c in batch.columns)):
                    new, n = learn(shared.value, np.frombuffer(ids, np.uint16), np.frombuffer(bounds, np.int64), r)
                    flat = new.ravel()
                    parts = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([unit] * len(parts)), pa.array([n] * len(parts)), pa.array(parts, pa.binary())], names=["part", "unit", "n", "sum"])

        sums, most, first = corpus.mapInArrow(run, SUMS), last, True
        while first or most > 0:
            sums, most, first = sums.groupBy("part", F.floor(F.col("unit") / FAN)).applyInPandas(_add(first), SUMS), most // FAN, False
        parts = sums.orderBy("part").collect()
        state = np.concatenate([np.frombuffer(p["sum"]) / max(p["n"], 1) for p in parts]).reshape(2, -1).astype(np.float32)
    return state[0]


# ---------------------------------------------------------------- scores


def score(rows: DataFrame, weights: np.ndarray, counts: Counts) -> DataFrame:
    """(id, n_tokens, log_likelihood) for every row of tokenised texts."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, counts.shared))

    def run(batches):
        weights, log_shared = shared.value
        net = Network(weights.copy())
        for batch in batches:
            for piece in pieces(batch, "ids"):
                n = np.asarray(piece.column("n_tokens"), np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                ids = np.frombuffer(b"".join(piece.column("ids").to_pylist()), np.uint16)
                row, at = padded(ids, bounds)
                each = np.zeros(len(ids) + 1)
                for i in range(0, len(ids), CHUNK):
                    some = at[i : i + CHUNK]
                    each[i : i + len(some)] = net.log_probability(contexts(row, some), row[some].astype(np.int64))
                rare = np.flatnonzero((ids >= COMMON) & (ids < COMMON + RARE))
                each[rare] -= log_shared[ids[rare] - COMMON]
                sums = np.where(n > 0, np.add.reduceat(each, bounds[:-1]), 0.0)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("row", "id", "n_tokens", "near")), pa.array(sums)], names=["row", "id", "n_tokens", "near", "network"])

    def explode(batches):
        for batch in batches:
            for piece in pieces(batch, "far", 4 << 20):
                words = np.frombuffer(b"".join(piece.column("far").to_pylist()), np.int64)
                row = np.repeat(np.asarray(piece.column("row"), np.int64), np.asarray(piece.column("size"), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(words)], names=["row", "word"])

    scored = cut(rows.select("row", "id", "n_tokens", "near", "ids").mapInArrow(run, "row long, id long, n_tokens long, near long, network double"), "scored")
    rest = rows.where("length(far) > 0").select("row", "far", (F.length("far") / 8).cast("long").alias("size"))
    rest = rest.mapInArrow(explode, "row long, word long").join(counts.far, "word")
    rest = rest.groupBy(F.col("row").alias("_row")).agg(F.sum(F.rint(F.log("n") / PART).cast("long")).alias("_more"))
    whole = F.col("near") + F.coalesce("_more", F.lit(0))
    return scored.join(rest, scored["row"] == rest["_row"], "left").select("id", "n_tokens", (F.col("network") + whole * PART).alias("log_likelihood"))


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_likelihood (sum) and per_token (its mean, null without tokens) under a network trained on docs."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known, token, counts = vocabulary(source)
    rows = tokenised(source, known, token, counts)
    scored = score(rows, train(units(rows)), counts)
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
