"""Repair of conversations' structure by a rank-convergence parallel Viterbi.

A conversation's rows, in order, are kept, given another role or deleted, and empty rows
are inserted, so that its roles read ``(system? (user assistant)+)?`` at the least cost;
of equally cheap ways the one with the ASCII-least string of edits (D, I, K, R) is taken.
A state is the last role given; a row's costs are a step of a min-plus recursion over four
states, and so are insertions.

1. All rows are put in one order by a range partitioning, so that a conversation of any
   length spans as many tasks as it needs, and cut into chunks of consecutive rows.
2. Going backwards, a chunk does not know the costs that the rest of its conversation
   still takes. It starts from speculative cost vectors, all that can occur but for a
   constant (a small closed set), and carries them through its rows together. Where they
   come to differ only by constants, the chunk's result no longer depends on its start.
3. Fix-up passes take the chunks whose vectors still differ and replace their start by
   their successor's result, which spans twice as many chunks in each pass, until all
   vectors differ by constants only. (Passes that rerun one more chunk each would need as many
   as there are chunks where they never agree, such as rows of one role.)
4. From the stitched backward costs each chunk traces the least edits from every state
   that it may be entered in; entries are stitched the same way, forwards.

Rows that must go (blank ones, and repeats of a role and text) change no cost difference.
Most conversations lie within a chunk and are solved at once.

Order: by turn, nulls first; rows of one turn by role, then by their text's first 64
characters, then by its hash. Texts are told apart by 128-bit hashes. Null roles and texts
count as one space; null ids are one conversation. Gaps beyond 64 bits count as the most of these. Exact repeats of a row are counted
before they are dealt. Empty tables give empty results, columns of any other name don't
matter. A conversation's edits as one string, and a SHA-256 of its text, come from a task
that streams its rows: it holds a batch and that string, not the conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DELETE, INSERT, RENAME, TRUNCATED = 4, 3, 3, 3
#: States: nothing given yet, then the last role. Ends: nothing, or assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after an insertion or a new role, by the state before.
NEXT = (USER, USER, ASSISTANT, USER)
#: Kinds of rows: s, u, a or another role; 4 more if truncated; or one that must go.
GOES = 8
#: A chunk has 2 to this power of rows that differ.
CHUNK_BITS = 12
BLANKS = " \t\n\x0b\f\r"
ORDER = ("conv", "turn", "role", "head", "h1", "h2")

Costs = tuple[int, int, int, int]
#: What the end of a conversation still costs in each state.
END: Costs = (0, 2 * INSERT, INSERT, 0)


# ---------------------------------------------------------------- the recursion


def _with_row(kind: int, after: Costs) -> list[dict[str, tuple[int, int]]]:
    """For each state the edits of a row: (cost to the end, next state)."""
    role, late = kind % 4, TRUNCATED * (kind // 4)
    out = []
    for state in range(4):
        edits = {"D": (DELETE + after[state], state)}
        if kind != GOES:
            if (role, state) in {(0, NOTHING), (2, USER)} or (role == 1 and state != USER):
                edits["K"] = (late + after[role + 1], role + 1)
            edits["R"] = (RENAME + late + after[NEXT[state]], NEXT[state])
        out.append(edits)
    return out


def _before(kind: int, after: Costs) -> Costs:
    """Costs to the end before a row, insertions in front of it included."""
    rows = [min(cost for cost, _ in edits.values()) for edits in _with_row(kind, after)]
    user, assistant = min(rows[USER], INSERT + rows[ASSISTANT]), min(rows[ASSISTANT], INSERT + rows[USER])
    return min(rows[NOTHING], INSERT + user), min(rows[SYSTEM], INSERT + user), user, assistant


def _trace(kind: int, after: Costs, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a row in a state, with insertions before it, and the state after."""
    before, edits, done = _before(kind, after), _with_row(kind, after), ""
    while True:
        if edits[state]["D"][0] == before[state]:
            return done + "D", state
        if INSERT + before[NEXT[state]] == before[state]:
            done, state = done + "I", NEXT[state]
            continue
        letter = next(x for x in "KR" if x in edits[state] and edits[state][x][0] == before[state])
        return done + letter, edits[state][letter][1]


class Tables:
    """The recursion by look-up: vectors but for a constant, closed under all kinds of rows; END is the first."""

    def __init__(self):
        self.vectors, index = [END], {END: 0}
        steps: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows meanwhile
            row = []
            for kind in range(GOES + 1):
                costs = _before(kind, vector)
                base = min(costs)
                rest = tuple(x - base for x in costs)
                if rest not in index:
                    index[rest] = len(self.vectors)
                    self.vectors.append(rest)
                row.append((index[rest], base))
            steps.append(row)
        self.step = [[steps[v][k][0] for v in range(len(steps))] for k in range(GOES + 1)]
        self.cost = [[steps[v][k][1] for v in range(len(steps))] for k in range(GOES + 1)]
        self.np_step, self.np_cost = np.array(self.step), np.array(self.cost)
        self.trace = [[[_trace(k, vector, s) for s in range(4)] for vector in self.vectors] for k in range(GOES + 1)]

    def speculate(self, kinds: bytes) -> tuple[list[int], list[int]]:
        """For every vector after the rows, the vector before them and the constant between."""
        now, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for i in range(len(kinds) - 1, -1, -1):
            if i % 16 == 0 and (now == now[0]).all():  # they differ by constants only
                vector, path = self.backward(kinds[: i + 1], int(now[0]))
                return [path[0]] * len(now), (cost + vector).tolist()
            cost += self.np_cost[kinds[i]][now]
            now = self.np_step[kinds[i]][now]
        return now.tolist(), cost.tolist()

    def backward(self, kinds: bytes, vector: int) -> tuple[int, list[int]]:
        """The constant over all rows, and the vector before each row and at the end."""
        cost, path = 0, [vector] * (len(kinds) + 1)
        for i in range(len(kinds) - 1, -1, -1):
            k = kinds[i]
            cost += self.cost[k][vector]
            path[i] = vector = self.step[k][vector]
        return cost, path

    def forward(self, kinds: bytes, path: list[int], state: int) -> tuple[str, int]:
        """Edits from a state, and the state after the rows."""
        out, trace = [], self.trace
        for k, after in zip(kinds, path[1:]):
            letters, state = trace[k][after][state]
            out.append(letters)
        return "".join(out), state


@lru_cache
def tables() -> Tables:
    return Tables()


def _rest(state: int) -> str:
    """Insertions at the end."""
    return "I" * (END[state] // INSERT)


# ---------------------------------------------------------------- rows


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by crc32(conv:turn) % 20; nulls in the string, roles and texts are one space."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    hit = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    told = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), hit.alias("hit")).where("hit <> 0")
    times = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return told.select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def plain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) as they are; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, how often they occur, and their place in the order of all (seq)."""
    ending = F.rtrim("text", F.lit(BLANKS))
    state = F.when(ending == "", 2).when(F.substring(ending, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    told = _keyed(rows).select(*ORDER, state.cast("byte").alias("state")).groupBy(*ORDER, "state").agg(F.count("*").alias("n"))
    role = F.substring("role", 1, 1)
    kind = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).cast("byte")
    return cut(told.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("seq", F.monotonically_increasing_id()).withColumn("kind", kind), "ordered")


def _sorted_runs(batches, columns: list[str]):
    """Rows as tuples of the columns' values."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _segments(schema: pa.Schema):
    """Rows come sorted by chunk and seq: a row for each conversation's part of a chunk."""
    names = ["chunk", *ORDER, "state", "n", "kind", "first"]

    def made(chunk, row, kinds, counts, ends, lead, last):
        return {**dict(zip(ORDER, row)), "chunk": chunk, "kinds": bytes(kinds), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "from_kind": ends[0], "to_kind": ends[1], "lead": lead, "last": last}

    def run(batches):
        out, here = [], None  # the open segment: [chunk, first row, kinds, counts, ends, lead]
        for chunk, *row in _sorted_runs(batches, names):
            *key, state, n, kind, first = row
            if here is None or here[0] != chunk or here[1][0] != key[0]:
                if here is not None:
                    out.append(made(*here, here[0] != chunk))
                here = [chunk, key, bytearray(), [0, 0, 0, 0], [kind, kind], here is None or here[0] != chunk]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            else:
                here[3][3] += (here[4][1], kind) not in {(0, 1), (1, 2), (2, 1)}
            here[2].append(kind + 4 * state if state < 2 and first else GOES)
            here[2] += bytes([GOES]) * (n - 1)
            here[3][3] += n - 1  # a role beside itself
            if state == 2:
                here[3][0] += n
            else:
                here[3][1] += n - bool(first)
                here[3][2] += bool(first) and state == 1
            here[4][1] = kind
        if here is not None:
            out.append(made(*here, True))
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _arrow(df_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


def _neighbours(heads: DataFrame, chunk_bits: int) -> DataFrame:
    """(chunk, g, opened, goes_on, from_before): chunks numbered in order, and whether a conversation goes on across their ends."""
    part = F.shiftrightunsigned("chunk", 33 - chunk_bits)
    per_part = heads.groupBy(part.alias("part")).agg(F.count("*").alias("chunks"))
    # as many rows as the order has partitions
    before = F.sum("chunks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = F.broadcast(per_part.select("part", F.coalesce(before, F.lit(0)).alias("start")))
    place = F.col("start") + F.col("chunk").bitwiseAND((1 << (33 - chunk_bits)) - 1)
    numbered = cut(heads.withColumn("part", part).join(start, "part").select("chunk", place.alias("g"), "first_conv", "last_conv", "last_kind"), "chunks")
    left = numbered.select((F.col("g") + 1).alias("g"), F.col("last_conv").alias("conv_before"), F.col("last_kind").alias("kind_before"), F.lit(True).alias("has_before"))
    right = numbered.select((F.col("g") - 1).alias("g"), F.col("first_conv").alias("conv_after"), F.lit(True).alias("has_after"))
    opened = F.coalesce(F.col("has_before"), F.lit(False)) & F.col("conv_before").eqNullSafe(F.col("first_conv"))
    goes_on = F.coalesce(F.col("has_after"), F.lit(False)) & F.col("conv_after").eqNullSafe(F.col("last_conv"))
    return numbered.join(left, "g", "left").join(right, "g", "left").select("chunk", "g", opened.alias("opened"), goes_on.alias("goes_on"), "kind_before")


def _solve(batches):
    """Whole conversations: edits and cost."""
    t = tables()
    for batch in batches:
        audits, costs = [], []
        for kinds in batch.column("kinds").to_pylist():
            cost, path = t.backward(kinds, 0)
            edits, state = t.forward(kinds, path, NOTHING)
            audits.append(edits + _rest(state))
            costs.append(cost + t.vectors[path[0]][NOTHING])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ORDER), batch.column("g"), pa.array(audits, pa.string()), pa.array(costs, pa.int64())], names=[*ORDER, "g", "audit", "cost"])


def _speculate(batches):
    """Parts of conversations: for each vector after them the one before, and the constant; the last part has one end only."""
    t = tables()
    for batch in batches:
        outs, costs = [], []
        for kinds, goes_on in zip(batch.column("kinds").to_pylist(), batch.column("goes_on").to_pylist()):
            out, cost = t.speculate(kinds)
            outs.append(out if goes_on else out[:1] * len(out))
            costs.append(cost if goes_on else cost[:1] * len(cost))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("g"), pa.array(outs, pa.list_(pa.int32())), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "g", "map", "costs"])


def _exits(batches):
    """The state after a part for each that it is entered in; the first part is entered in one only."""
    t = tables()
    for batch in batches:
        exits = []
        for kinds, vector, opened in zip(*(batch.column(c).to_pylist() for c in ("kinds", "vector", "opened"))):
            _, path = t.backward(kinds, vector)
            out = [t.forward(kinds, path, state)[1] for state in range(4)]
            exits.append(out if opened else out[:1] * 4)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("g"), pa.array(exits, pa.list_(pa.int32()))], names=["conv", "g", "map"])


def _edits_of_parts(batches):
    t = tables()
    for batch in batches:
        audits = []
        for kinds, vector, entry, goes_on in zip(*(batch.column(c).to_pylist() for c in ("kinds", "vector", "entry", "goes_on"))):
            _, path = t.backward(kinds, vector)
            edits, state = t.forward(kinds, path, entry)
            audits.append(edits if goes_on else edits + _rest(state))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ORDER), batch.column("g"), pa.array(audits, pa.string()), batch.column("cost")], names=[*ORDER, "g", "audit", "cost"])


def _constant(column: str) -> Column:
    return F.array_size(F.array_distinct(column)) == 1


def stitched(maps: DataFrame, toward: int) -> DataFrame:
    """(conv, g, value) of maps (conv, g, map) that are applied after the neighbour ``toward`` (1: the next, -1: the one before).

    Fix-up passes: a map that is not constant is put after its neighbour's, which spans twice as many in each pass.
    """
    span = 1
    while maps.where(~_constant("map")).take(1):
        other = maps.select(F.col("conv").alias("_conv"), (F.col("g") - toward * span).alias("_g"), F.col("map").alias("_map"))
        joined = maps.join(other, maps["conv"].eqNullSafe(other["_conv"]) & (maps["g"] == other["_g"]), "left")
        after = F.when(_constant("map") | F.col("_map").isNull(), F.col("map")).otherwise(F.transform("_map", lambda x: F.element_at("map", x + 1)))
        maps, span = cut(joined.select("conv", "g", after.alias("map")), "stitched"), 2 * span
    return maps.select("conv", "g", F.element_at("map", 1).alias("value"))


def _beside(values: DataFrame, toward: int, name: str) -> DataFrame:
    return values.select(F.col("conv").alias("_conv"), (F.col("g") - toward).alias("_g"), F.col("value").alias(name))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, left["conv"].eqNullSafe(right["_conv"]) & (left["g"] == right["_g"]), "left").drop("_conv", "_g")


def _long_ones(parts: DataFrame, solved: str) -> DataFrame:
    """Edits of conversations that lie in several chunks."""
    kind = parts.schema["conv"].dataType.simpleString()
    maps = cut(parts.mapInArrow(_speculate, f"conv {kind}, g long, map array<int>, costs array<long>"), "speculated")
    starts = stitched(maps.select("conv", "g", "map"), 1)
    known = _joined(_joined(parts, _beside(starts, 1, "vector")), _beside(starts, 0, "start"))
    known = _joined(known, maps.select(F.col("conv").alias("_conv"), F.col("g").alias("_g"), "costs"))
    vector = F.coalesce("vector", F.lit(0))  # END at the end
    first = F.array(*(F.lit(v[NOTHING]) for v in tables().vectors))
    cost = F.element_at("costs", vector + 1) + F.when(F.col("opened"), 0).otherwise(F.element_at(first, F.col("start") + 1))
    known = cut(known.select(*parts.columns, vector.cast("int").alias("vector"), cost.cast("long").alias("cost")), "known")
    exits = cut(known.mapInArrow(_exits, f"conv {kind}, g long, map array<int>"), "exits")
    entered = _joined(known, _beside(stitched(exits, -1), -1, "entry")).withColumn("entry", F.coalesce("entry", F.lit(NOTHING)))
    return entered.mapInArrow(_edits_of_parts, solved)


def repair_edits(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> tuple[DataFrame, DataFrame]:
    """From (conv, turn, role, text): a report of each conversation, and the edits of its chunks.

    Report: conv, gaps, blank, duplicate, truncated, illegal, cost. Edits: the order's columns of a chunk's first row, g and
    ``audit``, a letter for each row and insertion.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _ordered(rows)
    firsts = ordered.where("state < 2").groupBy("conv", "role", "h1", "h2").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    chunk = F.shiftrightunsigned("seq", chunk_bits)
    told = ordered.join(firsts, "seq", "left").withColumn("first", F.coalesce("first", F.lit(False))).withColumn("chunk", chunk)
    ddl = f"conv {kind}, turn long, role string, head string, h1 long, h2 long, chunk long, kinds binary, blank long, duplicate long, truncated long, illegal long, from_kind int, to_kind int, lead boolean, last boolean"
    parts = told.repartition("chunk").sortWithinPartitions("chunk", "seq").mapInArrow(_segments(_arrow(ddl)), ddl)
    parts = cut(parts, "segments")
    heads = parts.groupBy("chunk").agg(F.max(F.when(F.col("lead"), F.struct("conv"))).alias("a"), F.max(F.when(F.col("last"), F.struct("conv", "to_kind"))).alias("b"))
    around = _neighbours(heads.select("chunk", F.col("a.conv").alias("first_conv"), F.col("b.conv").alias("last_conv"), F.col("b.to_kind").alias("last_kind")), chunk_bits)
    parts = parts.join(around, "chunk")
    parts = parts.withColumn("opened", F.col("opened") & F.col("lead")).withColumn("goes_on", F.col("goes_on") & F.col("last"))
    pair = F.col("kind_before") * 4 + F.col("from_kind")
    parts = cut(parts.withColumn("illegal", F.col("illegal") + F.when(F.col("opened") & ~pair.isin(1, 6, 9), 1).otherwise(0)), "parts")

    solved = f"conv {kind}, turn long, role string, head string, h1 long, h2 long, g long, audit string, cost long"
    edits = parts.where("not opened and not goes_on").mapInArrow(_solve, solved)
    long_ones = parts.where("opened or goes_on")
    if long_ones.take(1):
        edits = edits.unionByName(_long_ones(cut(long_ones, "long"), solved))
    edits = cut(edits, "edits")

    turns = ordered.groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.countDistinct("turn").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    gaps = F.least(F.coalesce((wide("high") - wide("low") + 1 - wide("n")).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), most).cast("long")
    faults = parts.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    costs = edits.groupBy("conv").agg(F.sum("cost").alias("cost"))
    report = turns.select("conv", gaps.alias("gaps"))
    for side in (faults, costs):
        side = side.withColumnRenamed("conv", "_conv")
        report = report.join(side, report["conv"].eqNullSafe(side["_conv"])).drop("_conv")
    return report, edits


def _repaired(batches):
    """Chunks' edits and rows with texts come sorted, edits first: (conv, edit, role, text) for every edit."""
    conv, begun, letters, at, state = None, False, "", 0, NOTHING
    out: list[tuple] = []

    def inserted():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state = NEXT[state]
            out.append((conv, "I", ROLE[state], ""))
            at += 1

    def told():
        rows, out[:] = list(zip(*out)), []
        return pa.RecordBatch.from_arrays([pa.array(rows[0], schema) if rows else pa.array([], schema), *(pa.array(rows[c] if rows else [], pa.string()) for c in (1, 2, 3))], names=["conv", "edit", "role", "text"])

    schema = pa.null()
    for batch in batches:
        schema = batch.column("conv").type
        size = 0
        for this, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text"))):
            if audit is not None:
                if begun:
                    inserted()  # at the end of a conversation
                if not begun or this != conv:
                    conv, begun, state = this, True, NOTHING
                letters, at = audit, 0
                continue
            inserted()
            letter = letters[at]
            at += 1
            if letter == "D":
                out.append((conv, "D", role, text))
            else:
                state = NEXT[state] if letter == "R" else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                out.append((conv, letter, ROLE[state] if letter == "R" else role, text))
            size += len(text)
            if size > 1 << 22:
                size = 0
                yield told()
        yield told()
    inserted()
    if out:
        yield told()


def _dealt(rows: DataFrame, edits: DataFrame) -> DataFrame:
    texts = _keyed(rows).withColumn("audit", F.lit(None).cast("string")).withColumn("g", F.lit(None).cast("long"))
    both = edits.select(*ORDER, "g", "audit", F.lit(None).cast("string").alias("text")).unionByName(texts)
    return both.repartition("conv").sortWithinPartitions(*ORDER, F.col("g").asc_nulls_last()).select("conv", "audit", "role", "text")


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, edit, role, text): every row and insertion in order, deleted ones with edit D; a conversation is in one partition."""
    kind = rows.schema["conv"].dataType.simpleString()
    return _dealt(rows, edits).mapInArrow(_repaired, f"conv {kind}, edit string, role string, text string")


def _digests(batches):
    """(conv, edit, role, text) to (conv, audit, repaired_sha256)."""
    conv, begun, audit, digest, empty = None, False, [], None, True
    schema = pa.null()

    def told(done):
        rows = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], schema), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["conv", "audit", "repaired_sha256"])

    for batch in batches:
        schema, done = batch.column("conv").type, []
        for this, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or this != conv:
                if begun:
                    done.append((conv, "".join(audit), digest.hexdigest()))
                conv, begun, audit, digest, empty = this, True, [], hashlib.sha256(), True
            audit.append(edit)
            if edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if len(audit) > 1 << 12:
                audit = ["".join(audit)]
        yield told(done)
    if begun:
        yield told([(conv, "".join(audit), digest.hexdigest())])


def repair_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits in order, and the digest of the repaired ``role:text`` lines."""
    kind = rows.schema["conv"].dataType.simpleString()
    return _dealt(rows, edits).mapInArrow(lambda batches: _digests(_repaired(batches)), f"conv {kind}, audit string, repaired_sha256 string")


def conversation_repair(original: DataFrame, rows: DataFrame, conv_col: str = "conv_id", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """For every conversation of ``original``: faults, cost, audit and digest of its ``rows`` (conv, turn, role, text); zeros and empty ones if it has none."""
    report, edits = repair_edits(rows, chunk_bits)
    digests = repair_digests(rows, edits).withColumnRenamed("conv", "_conv")
    report = report.join(digests, report["conv"].eqNullSafe(digests["_conv"])).drop("_conv")
    every = original.select(F.col(conv_col)).distinct()
    out = every.join(report, every[conv_col].eqNullSafe(report["conv"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(conv_col, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
