import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitspark.llm import mixing
from pitspark.llm.mixing import mix_sources, water_fill


def brute_targets(sizes, epochs=3.0):
    """Clamp and redistribute until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > epochs * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            free.discard(s)
    return target


def test_targets_match_clamping_by_rounds(spark):
    rng = random.Random(0)
    for k in range(8):
        sizes = {(None if i == 0 and k % 2 else f"s{i}é"): rng.choice([1, 5, 40, 1000, 30000]) for i in range(rng.randint(1, 12))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in water_fill(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_taken_words_come_near_targets(docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    df = docs(rows)
    out = mix_sources(df).collect()
    again = {(r.doc_id, r.taken) for r in mix_sources(df).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    source = {i: s for i, _, s in rows}
    by = {}
    for r in out:
        assert r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 30 for t, n in by.values())


def test_edge_cases(docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "x " * 9000, "b"), (5, "x y", "b"), (5, "x y", "b"), (None, "z", "b")]
    out = mix_sources(docs(rows).withColumn("size", F.lit(9)).withColumn("target", F.lit("x"))).collect()
    assert len(out) == len(rows) and {r.size for r in out if r.doc_id in (1, 2, 3)} == {0} and all(r.taken == 0 for r in out if r.size == 0)
    assert mix_sources(docs([])).count() == 0
    assert {r.target for r in mix_sources(docs([(1, None, "a")])).collect()} == {0.0}


def brute_taken(rows):
    """Whole repetitions of all rows and, in the seeded order, the rows that fit into the rest by half at least."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    target, out = brute_targets(total), []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for s in total:
        whole, before = (target[s] // total[s] if total[s] else 0), 0
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (md5("0:" + (str(r[0]) if r[0] is not None else "text " + md5(r[1] or ""))), size(r[1]))):
            more = size(t) > 0 and before + size(t) / 2 <= target[s] - whole * total[s]
            out.append((i or -1, size(t), int(size(t) * (whole + more))))
            before += size(t)
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [mixing.BUCKET_ROWS, 20, 1])
def test_taken_words_match_brute_force(docs, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(2)
    rows = [(rng.choice([i, i, i, None, 7]), "w " * rng.randint(0, 30) + rng.choice(["", "x"]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in mix_sources(docs(rows)).collect()) == brute_taken(rows)


def test_kept_columns_come_with_their_row(docs):
    df = docs([(1, "a b", "s"), (1, "c", "t"), (None, None, None)]).selectExpr("*", "5 as size", "6 as kept", "7 as bucket")
    rows = mix_sources(df, keep=("doc_id", "text", "source")).collect()
    assert sorted(((r.doc_id or 0), r.text or "", r.source or "") for r in rows) == [(0, "", ""), (1, "a b", "s"), (1, "c", "t")]
