import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import vector_codes as codes


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    dims = -(-max(map(len, whole), default=0) // parts) * parts
    whole = [v + [0] * (dims - len(v)) for v in whole]
    width = dims // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [[min((away(v[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at) if a[p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    told = [(i, label, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for (i, _, label), a in zip(kept, nearest())]
    sums = {}
    for _, label, _, error in told:
        sums[label] = sums.get(label, 0) + error
    most = 2**63 - 1
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, code, min(error, most), min(most, sum(min(x[3], most) for x in told if x[1] == label)), sha) for i, label, code, error in told)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("error", F.lit("x")).withColumn("v", F.lit(1)).withColumn("of", F.lit(1))
    return sorted(tuple(r) for r in codes.vector_codes(df, **kw).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(i % 5, 0.2, 16))], None if i % 7 == 0 else int(i % 3)) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(30)] + [(2, rows[9][1], 2), (2, rows[9][1], 2)]
    assert run(spark, rows) == brute(rows)


def test_bounds_leave_out_evaluations_and_nothing_else(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 900, (3000, 64)).astype(np.int64) + 3000 * rng.integers(0, 4, (3000, 1))
    books = rows[:16].reshape(16, 8, 8).transpose(1, 0, 2)
    machine = codes.Codebooks(books, books[:, [0, 5, 10, 15]])
    index, least = machine.nearest(rows, machine.pivot_distances(rows))
    squares = np.square(rows.reshape(3000, 8, 1, 8) - books[None]).sum(3)
    assert (index == squares.argmin(2)).all() and (least == squares.min(2)).all()
    assert machine.evaluated < 0.6 * machine.possible == 0.6 * 3000 * 8 * 16


@pytest.mark.parametrize("kind,big", [("float", 3e30), ("double", 1e200)])
def test_large_components_are_exact(spark, kind, big):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)], i % 2) for i in range(40)] + [(50 + i, [float(np.float32(1e30)) if kind == "float" else big] * 4 + [i * 1e9, -1.0, 2.0**40, 0.5], 1) for i in range(5)]
    rows = [(i, [float(np.float32(x)) for x in v] if kind == "float" else v, label) for i, v, label in rows]
    assert run(spark, rows, kind) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, nan], 1), (4, [None, 1.0], 1), (5, [inf], 1)]
    assert run(spark, rows) == [] and run(spark, []) == []
    rows += [(7, [0.1] * 9, None), (6, [0.2, -0.3], 4), (6, [0.2, -0.2], 4)]  # fewer rows than entries, unequal lengths
    assert run(spark, rows) == brute(rows)
    rows += [(None, [0.5] * 8, 4), (-3, [0.25] * 8, None)]
    got = run(spark, [(i if i is not None else 99, v, x) for i, v, x in rows])
    assert got == brute([(i if i is not None else 99, v, x) for i, v, x in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r[1] for r in codes.vector_codes(df).where("vec_id is null").collect()} == {r[1] for r in got if r[0] == 99}
    with pytest.raises(ValueError):
        codes.vector_codes(df, entries=300)
