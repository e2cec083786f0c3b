import random
import re

import numpy as np
from pyspark.sql import functions as F

from pitspark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    marked = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_measures_match_brute_force():
    rng = random.Random(0)
    words = ["a", "bb", "#c", "d\n", "é€", "f!", "\t", "|", "g"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        assert Q.measure(text)[:5] == brute(text)
    assert Q.measure(None)[:5] == (0, 0, 0, 0, 0)


def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    clean = [". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(8)) for _ in range(120)]
    symbols = [t.replace(" ", " ### ") for t in clean[:12]]
    shouts = [t.upper().replace(" ", "!! ") for t in clean[12:24]]
    return clean[24:], symbols + shouts


def test_clean_texts_stay_and_junk_goes(docs):
    clean, junk = corpus()
    out = {r.doc_id: r for r in Q.quality_rules(docs(clean + junk)).collect()}
    assert all(out[i].kept for i in range(len(clean)))
    assert not any(out[len(clean) + i].kept for i in range(len(junk)))


def test_base_failures_and_edge_cases(docs):
    long = " ".join(f"word{i}" for i in range(20_000))
    phrase = "one two three four five six seven eight nine ten "
    rows = [None, "", " \n ", "too short", phrase * 12, long, long]
    out = {r.doc_id: r for r in Q.quality_rules(docs(rows)).collect()}
    assert [out[i].base_failed for i in range(7)] == [True] * 5 + [False] * 2
    assert not any(out[i].kept for i in range(5)) and out[5].quality == out[6].quality
    assert Q.quality_rules(docs([])).count() == 0


def test_keeps_columns_and_clashing_names(docs):
    text = " ".join(f"word{i}" for i in range(30))
    df = docs([text, None]).selectExpr("*", "'x' as votes", "1 as quality", "2 as id", "3 as n_words")
    kept = Q.quality_rules(df, keep=("doc_id", "text", "lang")).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in kept) == [(0, text, "en"), (1, None, "en")]
    assert len(Q.quality_rules(df).collect()) == 2


def test_repeated_and_null_ids_have_a_row_each(docs):
    text = " ".join(f"word{i}" for i in range(120))
    out = Q.quality_rules(docs([(1, text, "s"), (1, text, "s"), (1, "### " * 30, "s"), (None, text, None)])).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in out) == [(False, 30), (False, 120), (False, 120), (True, 120)]


def test_accents_made_of_marks_are_letters():
    text = "e\u0301te\u0301 " * 30
    measured = dict(zip(Q.MEASURES, Q.measure(text)))
    assert measured["n_letters"] == measured["word_chars"]


def test_a_noisy_rule_is_outvoted():
    """One rule votes bad on every third text whatever its worth; the others agree with it on bad texts only."""
    rng = np.random.default_rng(3)
    good = rng.random(6000) < 0.9
    p_bad = np.where(good[:, None], 0.01, 0.7) * np.ones(6)
    p_bad[:, 0] = 1 / 3
    votes = np.where(rng.random((6000, 6)) < p_bad, Q.BAD, Q.GOOD)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, _, likely = Q.estimate(rows, counts)
    verdict = {tuple(r): p >= 0.5 for r, p in zip(rows.tolist(), posterior)}
    alone = [Q.BAD] + [Q.GOOD] * 5
    assert verdict[tuple(alone)] and abs(likely[0, Q.GOOD, Q.BAD] - 1 / 3) < 0.05
    kept = np.array([verdict[tuple(v)] for v in votes.tolist()])
    assert (kept == good).mean() > 0.98 and (kept & (votes[:, 0] == Q.BAD)).sum() > 1500


def brute_estimate(texts):
    """The same estimation by plain loops over texts."""
    likely = [{k: {Q.BAD: Q.BAD_VOTES[k], Q.GOOD: 1 - Q.BAD_VOTES[k]} for k in (Q.BAD, Q.GOOD)} for _ in texts[0]]
    share, posterior = Q.SHARE, []
    for _ in range(Q.ROUNDS):
        posterior = []
        for text in texts:
            p = {Q.GOOD: share, Q.BAD: 1 - share}
            for rule, vote in zip(likely, text):
                for k in p:
                    p[k] *= rule[k][vote] if vote != Q.ABSTAIN else 1
            posterior.append(p[Q.GOOD] / (p[Q.GOOD] + p[Q.BAD]))
        share = (sum(posterior) + Q.TEXTS * Q.SHARE) / (len(texts) + Q.TEXTS)
        for j, rule in enumerate(likely):
            for k in rule:
                weight = {v: Q.TEXTS * (Q.BAD_VOTES[k] if v == Q.BAD else 1 - Q.BAD_VOTES[k]) for v in (Q.BAD, Q.GOOD)}
                for p, text in zip(posterior, texts):
                    if text[j] != Q.ABSTAIN:
                        weight[text[j]] += p if k == Q.GOOD else 1 - p
                for v in weight:
                    rule[k][v] = weight[v] / sum(weight.values())
    return posterior


def test_verdicts_match_a_brute_force_estimation(docs):
    clean, junk = corpus()
    short = [" ".join(t.split()[:30]) for t in clean[:15]]
    rows = Q.quality_rules(docs(clean + junk + short + ["too short", None])).collect()
    want = [r for r in rows if not r.base_failed]

    def votes(r):
        mean, distinct, letters = r.word_chars / r.n_words, r.n_distinct / r.n_words, r.n_letters / r.word_chars

        def part(x, whole, good, bad, least=1):
            return Q.ABSTAIN if whole < least else Q.GOOD if x / whole <= good else Q.BAD if x / whole >= bad else Q.ABSTAIN

        few = r.n_words < 50
        return [
            part(r.n_symbols, r.n_words, 0.02, 0.1), part(r.n_dup_lines, r.n_lines, 0, 0.1, 3), part(r.n_repeat_words, r.n_words, 0, 0.1),
            Q.GOOD if letters >= 0.95 else Q.BAD if letters < 0.9 else Q.ABSTAIN, part(r.n_upper, r.n_letters, 0.04, 0.2),
            Q.ABSTAIN if few else Q.GOOD if 4.4 <= mean <= 6 else Q.BAD if mean < 4.3 or mean > 6.5 else Q.ABSTAIN,
            Q.ABSTAIN if few or r.n_words >= 5000 else Q.GOOD if distinct >= 0.6 else Q.BAD if distinct < 0.55 else Q.ABSTAIN,
            Q.BAD if few else Q.GOOD if r.n_words >= 100 else Q.ABSTAIN,
        ]

    posterior = brute_estimate([votes(r) for r in want])
    assert all(abs(r.quality - p) < 1e-6 and r.kept == (p >= Q.KEEP) for r, p in zip(want, posterior))
    assert any(r.kept and Q.BAD in votes(r) for r in want)


def test_estimation_finds_the_good_class():
    rng = np.random.default_rng(0)
    good = rng.random(5000) < 0.85
    p_bad = np.where(good[:, None], 0.005, 0.4)
    votes = np.where(rng.random((5000, 6)) < p_bad, Q.BAD, Q.GOOD)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, share, _ = Q.estimate(rows, counts)
    verdict = {tuple(r): p >= 0.5 for r, p in zip(rows.tolist(), posterior)}
    assert np.mean([verdict[tuple(v)] == g for v, g in zip(votes.tolist(), good)]) > 0.95 and 0.75 < share < 0.95


def test_long_texts_are_judged_like_their_parts():
    import random

    rng = random.Random(11)
    part = [f"w{rng.randrange(1500)}" for _ in range(1000)]
    short, long = Q.measure(" ".join(part)), Q.measure(" ".join(" ".join(rng.sample(part, 1000)) for _ in range(40)))
    share = short[6] / short[0]
    assert long[0] == 40_000 and abs(long[6] / long[0] - share) < 1e-9
    poor = Q.measure("some words again and ".strip() + " once more" * 10_000)
    assert poor[0] >= 20_000 and poor[6] / poor[0] < 0.01


def test_repeated_windows_by_numbers_match_a_list_of_windows(monkeypatch):
    import random

    rng = random.Random(12)
    for n in (0, 5, 8, 9, 30, 400):
        for _ in range(20):
            words = [rng.choice("abcd") if n < 100 else rng.choice("abcdefghijklmnop") for _ in range(n)]
            often = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
            want = {i + k for i, w in enumerate(often) if often.count(w) > 1 for k in range(8)}
            assert Q.repeated(Q.word_ids(" ".join(words))[0]) == len(want)
    text = "One two. THREE # four\n\none two\n" * 9
    whole = Q.measure(text)
    monkeypatch.setattr(Q, "LONG", 5)
    assert Q.measure(text) == whole


def test_a_text_of_millions_of_words_within_bounds():
    import tracemalloc

    text = " ".join(f"w{i % 50_000}" for i in range(3_000_000))
    tracemalloc.start()
    got = Q.measure(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == got[4] == 3_000_000 and peak < 250 * 3_000_000
