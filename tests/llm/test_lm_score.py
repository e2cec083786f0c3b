import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitspark.llm import lm_score as L
from pitspark.llm.common import Words


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    net = L.Network(rng.normal(0, 0.3, L.Network.size()))
    context, target = rng.integers(0, L.SIZE, (40, 4)), rng.integers(0, L.SIZE, 40)
    g = L.Network.gradient(net, context, target)
    loss = lambda: -net.log_probability(context, target).mean()
    for at in [*np.argsort(-np.abs(g))[:12], *rng.integers(0, len(g), 5)]:
        old = net.flat[at]
        net.flat[at] = old + 1e-5
        up = loss()
        net.flat[at] = old - 1e-5
        down = loss()
        net.flat[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_probabilities_sum_to_one():
    net = L.Network.fresh()
    context = np.tile([1, 2, 3, 4], (L.SIZE, 1))
    assert abs(np.exp(net.log_probability(context, np.arange(L.SIZE))).sum() - 1) < 1e-3


def test_contexts_stay_in_their_text():
    row, at = L.padded(np.arange(4), np.array([0, 3, 3, 4]))
    end = L.SIZE - 1
    assert L.contexts(row, at).tolist() == [[end, end, 1, 2], [end, 0, 2, end], [0, 1, end, end], [end] * 4]
    assert row[at].tolist() == [0, 1, 2, 3]


def model(df, rounds=L.ROUNDS):
    source = df.select(F.col("doc_id").alias("id"), "text")
    known, token, counts = L.vocabulary(source)
    return L.train(L.units(L.tokenised(source, known, token, counts)), rounds), known, token, counts


def scores(df, weights, known, token, counts):
    source = df.select(F.col("doc_id").alias("id"), "text")
    return {r.id: r for r in L.score(L.tokenised(source, known, token, counts), weights, counts).collect()}


def ordered(rng, n):
    """Texts in which a word tells its neighbours."""
    out = []
    for _ in range(n):
        at, text = rng.randrange(50), []
        for _ in range(120):
            text.append(f"w{at}")
            at = (at * 3 + 1 + (rng.random() < 0.1)) % 50
        out.append(" ".join(text))
    return out


def test_scores_order_above_shuffles(docs):
    rng = random.Random(0)
    texts = ordered(rng, 400)
    shuffled = [" ".join(rng.sample(t.split(), 120)) for t in texts[:20]]
    out = scores(docs(ordered(rng, 20) + shuffled), *model(docs(texts)))
    mean = np.array([out[i].log_likelihood / out[i].n_tokens for i in range(40)])
    assert mean[:20].min() > mean[20:].max() and mean[:20].mean() > -np.log(50)


def test_scores_match_brute_force(docs):
    """Every word by a plain softmax over the whole vocabulary, a shared token by its words' counts."""
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(9000)}" for _ in range(rng.randint(1, 90))) for _ in range(150)]
    weights, known, token, counts = model(docs(texts))
    out, net = scores(docs(texts), weights, known, token, counts), L.Network(weights)
    names = {w: int(h) for t in texts for w, h in zip(t.split(), Words(pa.array([t])).hashes())}
    number, n = dict(zip(known.tolist(), token.tolist())), {}
    for t in texts:
        for w in t.split():
            n[w] = n.get(w, 0) + 1
    ids = {w: number.get(h, L.COMMON + h % L.RARE) for w, h in names.items()}
    seldom = {w for w in ids if names[w] not in number}
    assert len(seldom) > 50
    for i, t in enumerate(texts):
        row, total = [ids[w] for w in t.split()], 0.0
        for at, w in enumerate(t.split()):
            around = [row[k] if 0 <= k < len(row) else L.SIZE - 1 for k in (at - 2, at - 1, at + 1, at + 2)]
            h = np.tanh(np.concatenate([net.w["embed"][k] for k in around]) @ net.w["inner"] + net.w["inner_b"])
            kind = np.exp(h @ net.w["class"][:-1] + net.w["class"][-1])
            c = row[at] // L.SIDE
            member = np.exp(h @ net.w["member"][c][:-1] + net.w["member"][c][-1])
            total += np.log(kind[c] / kind.sum()) + np.log(member[row[at] % L.SIDE] / member.sum())
            if w in seldom:
                total += np.log(n[w] / (1 + sum(n[x] for x in seldom if ids[x] == ids[w])))
        assert abs(out[i].log_likelihood - total) < 1e-3 * max(1, abs(total)) and out[i].n_tokens == len(row)


@pytest.mark.parametrize("tokens", [L.UNIT_TOKENS, 500])
def test_scores_do_not_depend_on_partitions(docs, monkeypatch, tokens):
    monkeypatch.setattr(L, "UNIT_TOKENS", tokens)
    monkeypatch.setattr(L, "FAN", 3)
    df = docs(ordered(random.Random(1), 60) + ["same text"] * 5)
    one, five = (model(df.repartition(k)) for k in (1, 5))
    assert np.array_equal(one[0], five[0])
    # single precision rounds by the order in a batch
    one, five = ({r.doc_id: r.log_likelihood for r in L.lm_score(df.repartition(k)).collect()} for k in (1, 5))
    assert all(abs(one[i] - five[i]) < 1e-5 * abs(one[i]) for i in one)


def test_edge_cases(docs):
    df = docs([None, "", " \n", "one", "x y " * 20_000, "x y", "x y"]).withColumn("id", F.lit(1)).withColumn("n_tokens", F.lit(1))
    out = {r.doc_id: r for r in L.lm_score(df).collect()}
    assert [out[i].n_tokens for i in range(7)] == [0, 0, 0, 1, 40_000, 2, 2] and out[5].log_likelihood == out[6].log_likelihood
    assert all(out[i].log_likelihood == 0 and out[i].per_token is None for i in range(3))
    assert L.lm_score(docs([])).count() == 0 and L.lm_score(docs([None])).count() == 1


def test_every_position_is_learnt_from_once(docs, monkeypatch):
    monkeypatch.setattr(L, "UNIT_TOKENS", 700)
    df = docs([" ".join(f"w{i * k % 97}" for i in range(300)) for k in range(1, 40)])
    source = df.select(F.col("doc_id").alias("id"), "text")
    rows = L.units(L.tokenised(source, *L.vocabulary(source))).collect()
    assert len(rows) > 5 and len({r.unit for r in rows}) == len(rows)
    state = np.stack([L.Network.fresh().flat, np.ones(L.Network.size(), np.float32)])
    at = [np.arange(len(r.ids) // 2)[k :: L.ROUNDS] for r in rows for k in range(L.ROUNDS)]
    n = [L.learn(state, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.bounds, np.int64), k)[1] for r in rows for k in range(L.ROUNDS)]
    assert n == list(map(len, at)) and sum(n) == 39 * 300


@pytest.mark.parametrize("near", [L.NEAR, 0, L.COMMON + 35])
def test_rare_words_have_their_share_of_the_counts(docs, monkeypatch, near):
    monkeypatch.setattr(L, "NEAR", near)
    token = lambda w: int(Words(pa.array([w])).hashes()[0]) % L.RARE
    same = [w for w in (f"r{i}" for i in range(9000)) if token(w) == 7][:4]
    rng = random.Random(0)
    common = [f"c{i}" for i in range(L.COMMON)] * 8
    others = [f"o{i}" for i in range(40) if token(f"o{i}") != 7] * 4
    rare = [same[0]] * 5 + [same[1]] * 2 + [same[2]]
    words = common + others + rare
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    fitted = model(docs(texts))
    out = scores(docs([f"c1 c2 {w} c3 c4" for w in same] + [f"c1 {w} c3 {w} c4" for w in same[:2]]), *fitted)
    got = [out[i].log_likelihood for i in range(6)]
    for i, n in enumerate([5, 2, 1, 1]):
        assert abs(got[i] - got[3] - np.log(n)) < 1e-6
    assert abs(got[4] - got[5] - 2 * np.log(5 / 2)) < 1e-6
    assert abs(fitted[3].shared[7] - np.log(9)) < 1e-12
