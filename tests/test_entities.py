"""Names by edit distance: the gram index leaves out no similar pair, and most others."""

import random

import pytest
from pitspark.operators import joins as J


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.7, 0.85, 1.0])
def test_no_similar_pair_is_missing(spark, least):
    rng = random.Random(int(least * 100))
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(120)})
    asked = set()
    for k in known:
        x = list(k)
        for _ in range(rng.randint(0, 5)):
            at, what = rng.randrange(len(x) + 1), rng.random()
            x[at : at + (what < 0.66)] = [rng.choice("abcdef")] if what > 0.33 else []
        asked.add("".join(x).strip() or "b")
    asked = sorted(asked)
    got = {(r._r, r._k) for r in J.name_candidates(spark.createDataFrame([(x,) for x in asked], "_r string"), spark.createDataFrame([(x,) for x in known], "_k string"), least).collect()}
    want = {(r, k) for r in asked for k in known if 1 - levenshtein(r, k) / max(len(r), len(k)) >= least - 1e-12}
    assert want and want <= got
    if least >= 0.7:
        assert len(got) < 0.2 * len(asked) * len(known)


def test_few_candidates_for_a_name(spark):
    """Two thousand names of two made-up words out of 400, each asked with an error."""
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    known = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(2000)})
    asked = sorted({"x" + k[1:] for k in known})
    pairs = J.name_candidates(spark.createDataFrame([(x,) for x in asked], "_r string"), spark.createDataFrame([(x,) for x in known], "_k string"), 0.7).count()
    print(f"{pairs / len(asked):.1f} candidates a name of {len(known)}")
    assert len(asked) <= pairs < 0.02 * len(asked) * len(known)


def test_entities(spark):
    known = spark.createDataFrame([("Ann Lee",), ("ANN LEE!",), ("Bo",), ("",), (None,)], "name string")
    raw = spark.createDataFrame([(1, "ann leee"), (2, "xyz"), (3, None), (4, "bo"), (5, "b"), (6, "Ann  Lee")], "id long, raw string")
    got = {r.id: r.entity for r in J.resolve_entities(raw, known, "id", "raw", "name", 0.7).collect()}
    assert got == {1: "Ann Lee", 2: None, 3: None, 4: "Bo", 5: None, 6: "Ann Lee"}
    assert J.resolve_entities(raw, known.limit(0), "id", "raw", "name", 0.7).where("entity is not null").count() == 0
    assert J.resolve_entities(raw.limit(0), known, "id", "raw", "name", 0.7).count() == 0
