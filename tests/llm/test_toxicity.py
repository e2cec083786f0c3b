import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pitspark.llm import toxicity as T


def corpus(n=900):
    rng = random.Random(0)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(1500)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), "vile" + rng.choice(["", "ness", "ly", "st", "ish"]) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_texts(docs, spark):
    rows = corpus()
    df = docs([(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    machine = T.learn(df, labels.where(~T.held_out(F.col("doc_id"))))
    scores = {r.doc_id: r.score for r in T.toxicity(df, machine).collect()}
    held = {r.doc_id for r in labels.where(T.held_out(F.col("doc_id"))).collect()}
    right = np.mean([(scores[i] >= 0.5) == bool(y) for i, _, y in rows if i in held])
    assert right > 0.95 and all(0 <= s <= 1 for s in scores.values())


def test_pairs_carry_weight():
    """Only the pair of two features is toxic: no additive weights separate that."""
    rng = np.random.default_rng(0)
    rows = [np.array(sorted({*rng.integers(10, 400, 6), *([1] if a else []), *([2] if b else [])}), np.int32) for a, b in rng.random((4000, 2)) < 0.5]
    y = np.array([1.0 if 1 in r and 2 in r else 0.0 for r in rows])
    m = T.fit(rows, y)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert np.mean((m.logits(np.concatenate(rows), bounds) > 0) == (y > 0)) > 0.9
    assert T.Machine.unpack(m.pack()).bias == m.bias


def test_scores_match_the_double_sum(docs):
    """Bias, weights and every pair's inner product over the number of features, feature by feature."""
    rng = np.random.default_rng(1)
    m = T.Machine(-0.3, rng.normal(0, 0.2, 1 << T.BITS).astype(np.float32), rng.normal(0, 0.1, (1 << T.BITS, T.FACTORS)).astype(np.float32))
    texts = [t for _, t, _ in corpus(40)] + ["", "one"]
    got = {r.doc_id: r.score for r in T.toxicity(docs(texts), m).collect()}
    for i, t in enumerate(texts):
        x, _ = T.features(pa.array([t]))
        z = m.bias + sum(float(m.w[a]) for a in x)
        z += sum(float(m.v[a].astype(float) @ m.v[b].astype(float)) for k, a in enumerate(x) for b in x[:k]) / max(len(x), 1)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5


def test_repeated_ids_are_one_labelled_row(docs, spark):
    rows = corpus(300)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    one = T.learn(docs([(i, t, "s") for i, t, _ in rows]), labels)
    many = T.learn(docs([(i, t, "s") for i, t, _ in rows] + [(0, rows[0][1], "s")] * 500 + [(None, "x", "s")] * 3), labels.union(labels))
    assert one.bias == many.bias and np.array_equal(one.w, many.w)


def test_edge_cases(docs, spark):
    df = docs([None, "", "   ", "vile " * 20_000, "vile", "vile"]).withColumn("score", F.lit(3)).withColumn("y", F.lit(3))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in T.toxicity(df, T.learn(df, none)).collect()}
    assert len(out) == 6 and out[4] == out[5] and out[0] == out[1] and out[0] < 1e-6
    assert T.toxicity(docs([]), T.Machine()).count() == 0
    bucket, bounds = T.features(pa.array(["Vile, VILE vilest", None]))
    assert bounds.tolist() == [0, len(bucket), len(bucket)] and len(bucket) == 4
