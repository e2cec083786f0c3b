import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from pitspark.llm import conversation_repair as repair

BLANK = " \t\n\x0b\f\r"
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if hit == 4 else role, "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text)
        yield from [row] * (0 if hit == 0 else 2 if hit == 3 else 1)


def cheapest(rows):
    """Least (cost, edits, repaired lines) by trying all edits, state by state; rows: (role, text, must go, truncated)."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in STATES[state]:
                        best[role[0]] = min(best.get(role[0], (10**9,)), (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return best

    best = inserted({"": (0, "", [])})
    for role, text, goes, late in rows:
        after = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, cost + 4, "D", lines)]
            if not goes:
                for new, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new[:1] in STATES[state]:
                        ways.append((new[0], cost + price + 3 * late, letter, [*lines, f"{new}:{text}"]))
            for to, price, letter, kept in ways:
                after[to] = min(after.get(to, (10**9,)), (price, audit + letter, kept))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows, hurt=damaged):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(hurt([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts, told = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in mine:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = cheapest(told)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, hurt=repair.damage, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("x")).withColumn("seq", F.lit(1)).withColumn("audit", F.lit(2))
    out = repair.conversation_repair(df, hurt(df), **kw).collect()
    return {r[0]: tuple(r[1:]) for r in out}, len(out)


def made(rng, convs, most, roles=("system", "user", "assistant", "tool", "", None)):
    texts = ["Yes.", "No!", "why", "Why?", " ", "", None, "So it is.\n", "and", "end. \t", "ü…", "a. b"]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_matches_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = made(rng, [*range(60), None], 12) + made(rng, range(60, 90), 25, ("user", "assistant"))
    assert run(spark, rows, chunk_bits=bits) == (brute(rows), 91)


def test_rows_of_one_role_never_agree_and_are_stitched(spark):
    rows = [(1, i, "user", f"{i}.") for i in range(70)] + [(2, i, "tool", f"{i}.") for i in range(71)] + [(3, i, "user", "") for i in range(66)] + [(4, i, "uA"[i % 2] * 2, f"{i}.") for i in range(50)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(68)]
    assert run(spark, rows, repair.plain, chunk_bits=2)[0] == brute(rows, lambda rows: rows)


def test_speculative_vectors_give_what_the_end_gives():
    t, rng = repair.tables(), random.Random(3)
    assert t.vectors[0] == repair.END and len(t.vectors) == len(set(t.vectors)) <= 40
    for _ in range(200):
        kinds = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(0, 90)))
        out, cost = t.speculate(kinds)
        for v in range(len(t.vectors)):
            total, path = t.backward(kinds, v)
            assert (out[v], cost[v]) == (path[0], total)


def test_long_conversation_with_copies(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice([f"{i}.", "again."])) for i in range(1500)] + [(7, 3, "user", "same.")] * 300
    assert run(spark, rows, chunk_bits=4) == (brute(rows), 1)


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.conversation_repair(empty, repair.damage(empty)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, gone, "user", "Gone."), (None, None, None, None), (2, None, "user", "x" * 2_000_000), (2, None, "user", "x" * 2_000_000), (3, -(2**63), "user", "Hi."), (3, 2**63 - 5, "assistant", "Ho.")]
    got, n = run(spark, [r for r in rows if r[0] != 3])
    assert n == 3 and got == brute([r for r in rows if r[0] != 3])
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got, n = run(spark, rows)
    assert n == 4 and got[3][0] == 2**63 - 1


def test_repaired_rows_and_ids_of_another_kind(spark):
    rows = spark.createDataFrame([("b", 0, "assistant", "Hello."), ("b", 1, "user", "Well?"), ("b", 2, "user", "Well?"), ("a", 0, "user", "So.")], "conv_id string, turn long, role string, text string")
    plain = repair.plain(rows)
    _, edits = repair.repair_edits(plain)
    got = [tuple(r) for r in repair.repaired_rows(plain, edits).collect()]
    by = {k: list(g) for k, g in groupby(sorted(got, key=lambda r: r[0]), key=lambda r: r[0])}
    assert by["a"] == [("a", "K", "user", "So."), ("a", "I", "assistant", "")]
    assert [r[1:] for r in by["b"]] == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Well?"), ("D", "user", "Well?"), ("I", "assistant", "")]
