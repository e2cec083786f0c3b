"""N-gram Jaccard join by a token-group matrix.

Every text becomes the set of its word n-grams. Two texts link when
``den * |intersection| >= num * |union|``. The join is exact:

1. Equal sets are one node (128-bit fingerprint), so copies cost one row each.
2. Candidates: sets that link differ in at most D n-grams, D from their sizes.
   Splitting the hash range into more than D parts, all but D must be equal in both, so
   only sets that share parts' signatures can link, and a set that shares fewer than that
   with all others together links with none. Empty parts are no signatures where
   there are enough full ones. A passage, even one in most texts, gives no candidates
   unless many whole parts agree.
3. Sets are partitioned into groups of similar ones: each goes to the set among those
   with a signature of its own that shares most signatures with others, the hub of
   what they vary. Large groups are cut into blocks of bounded size, the hub in each.
   A group's row of the matrix, the union of its n-grams, is stored; a fixed part of the
   hash range does, as linked sets miss few n-grams of each other in any part. By that
   part, sets of a group that can't link to any other in it drop out; the others are
   opened and compared.
4. Sets that are linked so far are contracted. Where a signature still has sets of
   several components, each of its sets asks the later groups: its overlap with a
   group's union bounds its similarity to all that the group holds. Only groups that
   it can still reach are opened and compared set by set.
5. Comparisons return links that span the linked sets, not all pairs. Components
   follow by alternating star contraction.

A group of near copies of any size thus costs one comparison with its hub a set and a
block's own comparisons, not all pairs of its blocks. No worker holds a signature's sets
or a group's askers whole: they come in sorted runs, and askers are dealt in chunks.

Nulls, texts without words and blank texts have an empty set: n_shingles 0, no
links, their own component. Rows with the same id keep a row each; ids may be null
(a component's id is its smallest non-null one). Columns of any other name don't matter.
Any ratio from 0 (exclusive) to 1 is exact; the lower it is, the more sets share parts and
are compared. N-grams are told apart by 64-bit hashes, texts as long as they are.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, per_text, pieces, small

#: A block of a group holds about so many sets and n-grams, a chunk of askers so many sets; larger ones are cut, none is left out.
BLOCK_SETS, BLOCK_TOKENS, CHUNK = 1024, 1 << 20, 1024
#: The list of texts to read again has about 100 bytes a row: up to so many it is broadcast, else joined by a shuffle.
OPEN_ROWS = 300_000


# ---------------------------------------------------------------- sets and signatures


def token_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the bounds of each text's."""
    h, count = words.hashes(), np.diff(words.bounds)
    span = max(len(h) - n + 1, 0)
    gram = np.zeros(span, np.uint64)
    for i in range(n):
        gram += mix(h[i : i + span], i + 1) if span else gram
    gram, doc = mix(gram), words.doc[:span]
    whole = doc == words.doc[n - 1 :] if span else np.zeros(0, bool)
    gram, doc = gram[whole], doc[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        each = [mix(np.add.reduce(np.stack([mix(h[b + i : b + i + 1], 100 + i) for i in range(c)])), c) for b, c in zip(words.bounds[short], count[short])]
        gram, doc = np.concatenate([gram, *each]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        gram, doc = gram[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        gram[a:b].sort()
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[keep], np.searchsorted(doc[keep], np.arange(len(count) + 1))


def fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    a, b = per_text(mix(tokens, 7), bounds), per_text(mix(tokens, 8), bounds)
    n = np.diff(bounds).astype(np.uint64)
    both = np.stack([mix(a ^ mix(n, 9)), mix(b + mix(n, 10))], 1)
    return [row.tobytes() for row in both]


class Levels:
    """Size bands and, for each, the number of parts in which linked sets must agree once."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 3 // 2))

    def least(self, level: int) -> int:
        """One more than the n-grams in which linked sets differ at most."""
        return (self.den - self.num) * 2 * (self.low[level + 1] - 1) // (self.den + self.num) + 1

    def parts(self, level: int) -> int:
        """As many as ``least`` and, where these are short (under six n-grams in a set), so many more that those left empty can be spared."""
        m = least = self.least(level)
        size = self.low[level] * self.num / self.den  # of the smallest sets
        if 18 * (self.den - self.num) > self.den + self.num:
            for _ in range(9):
                empty = m * math.exp(-size / m)
                m = least + math.ceil(empty + 3 * empty**0.5)
                if m > 0.9 * self.low[level]:
                    return least
        return m

    def apart(self, level: int, n: int) -> int:
        """In how many n-grams a set of n differs at most from one that it links with at this level."""
        return min(self.least(level) - 1, (self.den - self.num) * n // self.num)

    def of(self, n: int) -> list[int]:
        """Its own band, and each above it in which a set can link: one more at most from 2/3 on, several below."""
        level = bisect_right(self.low, n) - 1
        top = level + 1
        while top < len(self.low) - 1 and self.den * n >= self.num * self.low[top]:
            top += 1
        return list(range(level, top))


def signatures(tokens: np.ndarray, levels: Levels) -> list[tuple[np.ndarray, int]]:
    """For each of a sorted set's levels a 48-bit number for each part, and how many of them a linked set must have; none if only equal sets link."""
    out: list[tuple[np.ndarray, int]] = []
    if not len(tokens):
        return out
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens, 11), out=total[1:])
    for level in levels.of(len(tokens)):
        m, least = levels.parts(level), levels.least(level)
        if m > 1:
            width = (1 << 64) // m
            at = np.searchsorted(tokens, np.arange(1, m, dtype=np.uint64) * np.uint64(width))
            at = np.concatenate([[0], at, [len(tokens)]])
            sig = mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.arange(m, dtype=np.uint64), 1000 + level)) >> np.uint64(16)
            full = at[1:] > at[:-1]
            n_full = int(full.sum())
            # of the full parts, no more differ than n-grams do; with least of them, one that is full in both sets agrees
            out.append((sig[full] if n_full >= least else sig, max(1, n_full - levels.apart(level, len(tokens)))))
    return out


BASE = pa.schema([("id", pa.int64()), ("row", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("node", pa.int64())])


def _describe(n: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                tokens, bounds = token_sets(Words(piece.column("text"), lower=True), n)
                fps = fingerprints(tokens, bounds)
                node = np.frombuffer(b"".join(fps), np.int64)[::2]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("id", "row", "key")), pa.array(np.diff(bounds), pa.int64()), pa.array(fps, pa.binary()), pa.array(node)], schema=BASE)

    return run


# ---------------------------------------------------------------- candidates

#: Nodes that a task remembers, so that copies give their signatures once, and wanted sets, so that copies are read once.
SEEN = 1 << 19
#: More than the bands that a set can sign: they grow by half, and there are 70 or so.
LEVELS = 128


def _signed(n: int, num: int, den: int):
    """Texts to (signature, node, need), once for each node of a task, however many copies it holds; need is ``LEVELS`` times what must agree, plus the number of the level."""

    def run(batches):
        levels, seen = Levels(num, den), set()
        for batch in batches:
            for piece in pieces(batch):
                tokens, bounds = token_sets(Words(piece.column("text"), lower=True), n)
                nodes = np.frombuffer(b"".join(fingerprints(tokens, bounds)), np.int64)[::2].tolist()
                sigs, node, need = [np.zeros(0, np.uint64)], [], []
                for x, a, b in zip(nodes, bounds[:-1], bounds[1:]):
                    if a < b and x not in seen:
                        seen.add(x)
                        for up, (sig, least) in enumerate(signatures(tokens[a:b], levels)):
                            sigs.append(sig)
                            node.append(x)
                            need.append(LEVELS * least + up)
                if len(seen) > SEEN:
                    seen.clear()
                size = np.array([len(x) for x in sigs[1:]], np.int64)
                sig = np.concatenate(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(np.array(node, np.int64), size)), pa.array(np.repeat(np.array(need, np.int64), size))], names=["sig", "node", "need"])

    return run


def _shared(batches):
    """Rows (signature, node, need) come sorted: those whose signature has several nodes, once each. Only the last row is held."""
    last = None  # and whether it went out
    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        if not len(rows[0]):
            continue
        if last is not None:
            rows = [np.concatenate([[x], c]) for x, c in zip(last[0], rows)]
        out = last is not None and last[1]
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        sig, node, need = (c[new] for c in rows)
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        last = (sig[-1], node[-1], need[-1]), bool(keep[-1]) or (out and len(sig) == 1)
        keep[0] &= not out
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep]), pa.array(need[keep])], names=["sig", "node", "need"])


def _alive(shared: DataFrame) -> DataFrame:
    """(signature, node) of the sets that share as many signatures of a level as a link takes."""
    enough = shared.groupBy("node", "need").agg(F.count("*").alias("n")).where(F.col("n") >= F.floor(F.col("need") / LEVELS)).select("node").distinct()
    return cut(shared.join(small(cut(enough, "enough"), OPEN_ROWS), "node", "left_semi").select("sig", "node"), "alive")


# ---------------------------------------------------------------- groups

def _limit(num: int, den: int) -> np.uint64:
    """The end of the part of the hash range that bounds are taken from: sets that link agree in half of it at least."""
    return np.uint64(min((1 << 64) - 1, (1 << 65) * (den - num) // den))


def _read(n: int, keys: list[str], limit: np.uint64 | None = None):
    """The wanted sets' sizes and n-grams (below the limit), made again from the text; a row whose key fits but whose set doesn't is left.

    The rows of a text for several groups follow each other: its n-grams are made once.
    """

    def run(batches):
        done: set = set()
        for batch in batches:
            for piece in pieces(batch):
                # rows with one key may be copies of one text: a task gives a wanted set once
                wanted = list(zip(*(piece.column(c).to_pylist() for c in [*keys, "fp"])))
                left = [i for i, x in enumerate(wanted) if x not in done]
                if len(left) < len(wanted):
                    piece, wanted = piece.take(pa.array(left, pa.int64())), [wanted[i] for i in left]
                fps = [x[-1] for x in wanted]
                text = piece.column("text").to_pylist()
                new = np.array([i == 0 or fps[i] != fps[i - 1] or text[i] != text[i - 1] for i in range(len(fps))], bool)
                tokens, bounds = token_sets(Words(piece.column("text").filter(pa.array(new)), lower=True), n)
                made, of = fingerprints(tokens, bounds), np.cumsum(new) - 1
                fits = []
                for i, fp in enumerate(fps):
                    if made[of[i]] == fp and wanted[i] not in done:
                        fits.append(i)
                        done.add(wanted[i])
                if len(done) > SEEN:
                    done.clear()
                keep = pa.array(fits, pa.int64())
                sets = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                if limit is not None:
                    sets = [x[: np.searchsorted(x, limit)] for x in sets]
                packed, size = [x.tobytes() for x in sets], np.diff(bounds)
                of = of[np.asarray(keep)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(keep) for c in keys), pa.array(size[of], pa.int64()), pa.array([packed[i] for i in of.tolist()], pa.binary())], names=[*keys, "n", "tokens"])

    return run


class Group:
    """A row of the matrix: the sets of a group and their union."""

    def __init__(self, sets: dict[bytes, np.ndarray]):
        self.fps, self.sets = list(sets), list(sets.values())
        self.size = np.array([len(x) for x in self.sets])


def _member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, x)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == x


def _dense(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, x in enumerate(sets):
        x = x[(x >= columns[0]) & (x <= columns[-1])]
        at = np.searchsorted(columns, x)
        out[i, at[columns[at] == x]] = 1
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The intersection size of each set of a with each of b."""
    if len(a) == 1 and len(b) == 1:
        x, y = (a[0], b[0]) if len(a[0]) <= len(b[0]) else (b[0], a[0])
        return np.array([[int(_member(x, y).sum()) if len(y) else 0]])
    union_a, union_b = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    columns = union_a[_member(union_a, union_b)] if len(union_b) else union_b
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(columns), 4096):
        part = columns[i : i + 4096]
        out += _dense(a, part) @ _dense(b, part).T
    return out.astype(np.int32)


def linked(a: Group, b: Group | None, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links that span the linked sets of two groups, or of one (b: None)."""
    other = b or a
    both = shared_counts(a.sets, other.sets)
    link = den * both >= num * (a.size[:, None] + other.size[None, :] - both)
    if b is None:
        np.fill_diagonal(link, False)
    todo_a, todo_b, out = np.ones(len(a.sets), bool), np.ones(len(other.sets), bool), []
    for i in range(len(a.sets)):
        if not todo_a[i]:
            continue
        todo_a[i] = False
        root, front = a.fps[i], np.array([i])
        while len(front):
            new_b = link[front].any(0) & todo_b
            out += [(root, other.fps[j]) for j in np.flatnonzero(new_b)]
            todo_b &= ~new_b
            new_a = (new_b if b is None else link[:, new_b].any(1)) & todo_a
            if b is not None:
                out += [(root, a.fps[j]) for j in np.flatnonzero(new_a)]
            todo_a &= ~new_a
            front = np.flatnonzero(new_a)
    return out


def _runs(batches, keys: int):
    """(key, rows) for the runs of rows, as lists, that agree in their first columns; a run may come in several batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


MATRIX = pa.schema([("gid", pa.int64()), ("node", pa.int64()), ("tokens", pa.binary())])


def _matrix(num: int, den: int):
    """Rows (group, node, size, n-grams of the part) come sorted by group: its union, and the sets that may link to another in it."""

    def run(batches):
        for (gid,), rows in _runs(batches, 1):
            sets = {node: (n, np.frombuffer(tokens, np.uint64)) for node, n, tokens in rows}
            part = [x for _, x in sets.values()]
            whole, size = np.array([n for n, _ in sets.values()]), np.array([len(x) for x in part])
            apart = size[:, None] + size[None, :] - 2 * shared_counts(part, part)
            near = (den + num) * apart <= (den - num) * (whole[:, None] + whole[None, :])
            node = [x for x, ok in zip(sets, near.sum(1) > 1) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([gid] * (len(node) + 1)), pa.array([None, *node], pa.int64()), pa.array([np.unique(np.concatenate(part)).tobytes()] + [None] * len(node), pa.binary())], schema=MATRIX)

    return run


def _bound(num: int, den: int):
    """Rows (group, chunk, asks, node, size, n-grams of the part) come sorted, the union first: the askers that miss few enough of theirs in it."""

    def run(batches):
        key = union = None
        for batch in batches:
            found = []
            for gid, chunk, asks, node, n, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if not asks:
                    key, union = (gid, chunk), np.frombuffer(tokens, np.uint64)
                elif key == (gid, chunk):
                    x = np.frombuffer(tokens, np.uint64)
                    missing = len(x) - (int(_member(x, union).sum()) if len(union) else 0)
                    if den * missing <= (den - num) * n:
                        found.append((gid, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["gid", "node"])

    return run


def _inside(num: int, den: int):
    """Rows (group, fp, n-grams) come sorted by group: the links within it."""

    def run(batches):
        for _, rows in _runs(batches, 1):
            links = linked(Group({fp: np.frombuffer(tokens, np.uint64) for fp, tokens in rows}), None, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in range(2)], names=["a", "b"])

    return run


def _across(num: int, den: int):
    """Rows (group, chunk, asks, fp, n-grams) come sorted by group and chunk: links of the askers with the group's sets."""

    def run(batches):
        for _, rows in _runs(batches, 2):
            sides = [{fp: np.frombuffer(tokens, np.uint64) for asks, fp, tokens in rows if asks == side} for side in (True, False)]
            links = linked(*map(Group, sides), num, den) if all(sides) else []
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in range(2)], names=["a", "b"])

    return run


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps. A hub's neighbours meet only in a
    minimum, which is taken before the shuffle.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "low")
        # large star: neighbours above a node go to the lowest around it; small star: the node itself goes there
        large = pairs.join(low, pairs["v"] == low["x"]).select("u", F.col("m").alias("v"))
        stars = large.unionByName(low.where("m < x").select(F.col("x").alias("u"), F.col("m").alias("v"))).where("v < u")
        down = stars.groupBy("u").agg(F.min("v").alias("m"))
        down = cut(down, "down")
        nxt = stars.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("v < u").distinct()
        nxt = cut(nxt, "links")
        # done when every edge points at a node that points nowhere, and each node has one edge
        top = nxt.select(F.col("v").alias("u")).distinct().join(nxt.select("u").distinct(), "u", "left_semi")
        many = nxt.groupBy("u").count().where("count > 1")
        if not top.unionByName(many.select("u")).take(1):
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs = nxt


# ---------------------------------------------------------------- the operator


def _led(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, node, key, n, leader): for each set with company the one, of those with a signature of its own, that shares most signatures."""
    ranks = shared.groupBy("node").agg(F.count("*").alias("rank"))
    ranked = shared.join(ranks, "node").select("sig", "node", F.struct("rank", "node").alias("who"))
    first = ranked.groupBy("sig").agg(F.max("who").alias("first"))
    leaders = shared.join(first, "sig").groupBy("node").agg(F.max("first").alias("first"))
    return nodes.join(leaders, "node").select("fp", "node", "key", "n", F.col("first.node").alias("leader"))


def _grouped(led: DataFrame) -> DataFrame:
    """led with the block of its leader's group that each set is in."""
    heavy = led.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    heavy = small(cut(heavy.select("leader", blocks.alias("blocks")).where("blocks > 1"), "heavy"))
    gid = F.when(F.col("blocks") > 1, F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("blocks")))).otherwise(F.col("leader"))
    return led.join(heavy, "leader", "left").select("fp", "node", "key", "n", "leader", gid.alias("gid"))


def _asked(shared: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(gid, node): the groups that a set must ask. Where a signature's sets have one component nothing is left to ask.

    A set asks groups after its own only: of two linked sets in two groups, one asks.
    """
    rows = shared.join(placed.select("node", "n", "gid", "root"), "node")
    several = rows.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
    rows = cut(rows.join(several, "sig"), "several")
    groups = rows.groupBy("sig", F.col("gid").alias("g")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    fits = (F.col("n") * den >= F.col("least") * num) & (F.col("most") * den >= F.col("n") * num)
    new = (F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))
    return rows.join(groups, "sig").where((F.col("gid") < F.col("g")) & fits & new).select(F.col("g").alias("gid"), "node").distinct()


def _chunks(asked: DataFrame) -> DataFrame:
    """(gid, chunks): into how many chunks a group's askers are dealt."""
    return small(cut(asked.groupBy("gid").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "chunks"))


def _asker(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(chunks, "gid").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("asks", F.lit(True)).drop("chunks")


def _held(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """What groups hold, once for each chunk of their askers."""
    held = groups.join(chunks, "gid").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return held.withColumn("asks", F.lit(False)).drop("chunks")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, row: Column | None = None) -> DataFrame:
    """One row per row of docs: the id, ``n_shingles`` and ``component_id``, the smallest id reached by links.

    ``row``: a binary key of a row, carried along as column ``row``, with ``first``, true on one row of each component
    (of the smallest id, nulls last, then of the smallest key) and on every row without words; equal keys are one row.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must be above 0 and 1 at most")
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    own = F.lit(None).cast("binary") if row is None else row
    source = docs.select(F.col(id_col).cast("long").alias("id"), own.alias("row"), key.alias("key"), F.col(text_col).alias("text"))
    base = cut(source.mapInArrow(_describe(n), "id long, row binary, key long, n long, fp binary, node long"), "sets")
    nodes = cut(base.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("node").alias("node")), "nodes")

    # made from the texts again: written down, they would be longer than these
    rows = source.select("text").mapInArrow(_signed(n, num, den), "sig long, node long, need long")
    rows = rows.repartition("sig").sortWithinPartitions("sig", "node")
    shared = _alive(cut(rows.mapInArrow(_shared, "sig long, node long, need long"), "shared"))
    grouped = cut(_grouped(cut(_led(shared, nodes), "led")), "grouped")
    # a leader's own group may be another's: it joins each block of its own
    heads = grouped.select(F.col("leader").alias("node"), "gid").distinct().join(nodes.select("node", "fp", "key"), "node")
    heads = heads.join(grouped.select("gid", "node"), ["gid", "node"], "left_anti").select("gid", "node", "fp", "key", F.lit(False).alias("home"))
    members = cut(grouped.select("gid", "node", "fp", "key", F.lit(True).alias("home")).unionByName(heads), "members")

    def texts(wanted: DataFrame) -> DataFrame:
        return source.select("key", "text").join(small(wanted, OPEN_ROWS), "key")

    # the matrix, and links within groups
    part = texts(members).mapInArrow(_read(n, ["gid", "node", "home"], _limit(num, den)), "gid long, node long, home boolean, n long, tokens binary")
    part = cut(part, "part")
    dealt = part.select("gid", "node", "n", "tokens").repartition("gid").sortWithinPartitions("gid")
    matrix = cut(dealt.mapInArrow(_matrix(num, den), "gid long, node long, tokens binary"), "matrix")
    opened = cut(members.join(matrix.where("node is not null").select("gid", "node"), ["gid", "node"], "left_semi").select("gid", "fp", "key"), "opened")
    sets = texts(opened).mapInArrow(_read(n, ["gid", "fp"]), "gid long, fp binary, n long, tokens binary").drop("n")
    links = sets.repartition("gid").sortWithinPartitions("gid").mapInArrow(_inside(num, den), "a binary, b binary")
    roots = components(links)

    # links across groups
    placed = cut(grouped.join(roots, grouped["fp"] == roots["node"], "left").select(grouped["node"], "n", "gid", F.coalesce("root", "fp").alias("root")), "placed")
    asked = cut(_asked(shared, placed, num, den), "asked")
    chunks = _chunks(asked)
    asks = part.where("home").drop("gid", "home").join(small(asked, OPEN_ROWS), "node")
    unions = matrix.where("node is null").select("gid", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), "tokens")
    rows = _held(chunks, unions).unionByName(_asker(chunks, asks)).select("gid", "chunk", "asks", "node", "n", "tokens")
    rows = rows.repartition("gid", "chunk").sortWithinPartitions("gid", "chunk", "asks")
    reach = cut(rows.mapInArrow(_bound(num, den), "gid long, node long"), "reach")
    chunks = _chunks(reach)
    asks = _asker(chunks, reach).join(members.where("home").select("node", "fp", "key"), "node")
    opened = cut(_held(chunks, members).unionByName(asks, allowMissingColumns=True).select("gid", "chunk", "asks", "fp", "key"), "opened")
    sets = texts(opened).mapInArrow(_read(n, ["gid", "chunk", "asks", "fp"]), "gid long, chunk long, asks boolean, fp binary, n long, tokens binary").drop("n")
    links = sets.repartition("gid", "chunk").sortWithinPartitions("gid", "chunk").mapInArrow(_across(num, den), "a binary, b binary")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))

    named = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = cut(named.join(cut(lowest, "lowest"), "root").select("fp", "component_id", "root"), "labels")
    out = base.select("id", "row", "n", "fp").join(labels, "fp", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    told = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component]
    if row is None:
        return out.select(*told)
    out = cut(out.select(*told, "row", "root"), "rows")
    leads = out.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "row")).alias("lead"))
    leads = leads.select(F.col("lead.row").alias("_row")).distinct()
    return out.join(leads, out["row"] == leads["_row"], "left").select(id_col, "n_shingles", "component_id", "row", (F.col("root").isNull() | F.col("_row").isNotNull()).alias("first"))
