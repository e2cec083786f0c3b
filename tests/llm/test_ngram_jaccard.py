import random
import re
from collections import Counter

import numpy as np
import pytest

from pitspark.llm import ngram_jaccard as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, num=90, den=100):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(s), i if not s else low.get(find(k))) for k, (i, s) in enumerate(sets) if i is not None)


def run(df, **kw):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_jaccard(df, **kw).collect() if r.doc_id is not None)


def near_copies(seed, n, sizes, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for size in sizes:
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_matches_brute_force_on_near_copies(docs, monkeypatch):
    texts = near_copies(1, 14, [9, 10, 11, 12, 20, 60, 200, 400], 9)
    assert run(docs(texts)) == brute(list(enumerate(texts)))


def test_blocks_of_large_groups_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SETS", 5)
    texts = near_copies(2, 60, [80, 81], 4)
    assert run(docs(texts)) == brute(list(enumerate(texts)))


def test_edge_cases(docs):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, "s"), (2, "", None), (3, " \n\t ", "s"), (4, "One two", "s"), (5, "one  TWO", "s"), (6, "two one", "s"), (7, "a a a a a", "s"), (8, "a a a", "s"), (9, long, "s"), (10, long + " end", "s"), (10, "other text of the same id here", "s"), (None, "one two", "s"), (11, "Äa b c", "s"), (12, "äa b c", "s")]
    assert run(docs(rows)) == brute([(i, t) for i, t, _ in rows])
    assert run(docs([])) == []


def test_extra_columns_with_clashing_names(docs, spark):
    df = docs(["a b c d e f g h i j k l", "a b c d e f g h i j k l"]).selectExpr("*", "1 as id", "'x' as fp", "2 as n", "3 as gid", "4 as sig")
    assert [c for _, _, c in run(df)] == [0, 0]


def test_other_thresholds(docs):
    texts = near_copies(3, 12, [40, 90], 6)
    assert run(docs(texts), num=70) == brute(list(enumerate(texts)), num=70)


def agree(a, b, levels):
    """Whether b has as many of a's signatures, at one level, as a link takes."""
    theirs = {int(x) for sig, _ in N.signatures(b, levels) for x in sig}
    return any(sum(int(x) in theirs for x in sig) >= need for sig, need in N.signatures(a, levels))


def linked(a, b, levels):
    both = len(np.intersect1d(a, b))
    return len(a) != both and levels.den * both >= levels.num * (len(a) + len(b) - both)


@pytest.mark.parametrize("num", [30, 50, 60, 66, 70, 80, 90])
def test_linked_sets_agree_in_enough_parts(num):
    rng = np.random.default_rng(num)
    levels, seen = N.Levels(num, 100), 0
    for n in (10, 20, 30, 100, 500, 3000):
        for _ in range(40):
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            lost = rng.integers(0, max(1, n * (100 - num) // 100) + 1)
            a, b = base, np.unique(np.concatenate([base[rng.permutation(n)[lost:]], rng.integers(0, 2**63, max(0, n * (100 - num) // 150 - lost)).astype(np.uint64)]))
            if linked(a, b, levels):
                seen += 1
                assert agree(a, b, levels) and agree(b, a, levels)
            # what differs lies all in one place
            b = base[lost:]
            if linked(a, b, levels):
                assert agree(a, b, levels) and agree(b, a, levels)
    assert seen > 50


def test_a_passage_makes_no_candidates():
    """Sets that have a third of their n-grams in common, as by a passage, agree in too few parts."""
    rng = np.random.default_rng(1)
    levels = N.Levels(80, 100)
    for n in (150, 500, 2000):
        common = rng.integers(0, 2**63, n // 3).astype(np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - n // 3).astype(np.uint64) * np.uint64(2)])) for _ in range(60)]
        rows = [(i, need, int(x)) for i, s in enumerate(sets) for sig, need in N.signatures(s, levels) for x in sig]
        often = Counter(x for _, _, x in rows)
        share = Counter((i, need) for i, need, x in rows if often[x] > 1)
        assert sum(k >= need for (_, need), k in share.items()) <= 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500)], "a long, b long")
    roots = {r.node: r.root for r in N.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}


@pytest.mark.parametrize("num", [30, 50, 60, 66])
def test_links_below_two_thirds_are_all_found(docs, num):
    rng = random.Random(num)
    words = [f"w{i}" for i in range(60)]
    texts = ["a b", "a b c d", "a b c d e f g h"]
    for _ in range(160):
        base = rng.sample(words, rng.randint(2, 40))
        texts += [" ".join(base), " ".join(base[: max(1, int(len(base) * rng.uniform(0.3, 1)))])]
    assert run(docs(texts), n=1, num=num) == brute_one(texts, num)


def brute_one(texts, num):
    sets = [frozenset(t.split()) for t in texts]
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= num * len(x | y) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return [(i, len(x), root[i]) for i, x in enumerate(sets)]


def test_copies_without_an_id_are_read_once_a_task(spark):
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(40))
    tokens, bounds = N.token_sets(N.Words(pa.array([text]), lower=True), 3)
    fp = N.fingerprints(tokens, bounds)[0]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 500), pa.array([fp] * 500, pa.binary()), pa.array([text] * 499 + ["other"])], names=["gid", "fp", "text"])
    out = list(N._read(3, ["gid"])(iter([batch, batch])))
    assert sum(b.num_rows for b in out) == 1
    rows = [(None, text)] * 3000 + [(4, text + " more"), (9, "some other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in N.ngram_jaccard(df).collect()}
    assert got == {(None, 4), (4, 4), (9, 9)}
    with pytest.raises(ValueError):
        N.ngram_jaccard(df, num=0)
