import hashlib
import random

import pytest

import corpus_pipeline as C
from pitspark.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == list(C.COLUMNS), name
        kept = {r.doc_id for r in docs.collect()}
        assert kept and kept <= ids
        ids = kept
    want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = C.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.collect()) == want


def test_duplicates_and_junk_leave(docs, spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    clean = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    df = docs(clean + clean[:20] + ["short", "### " * 100, None])
    kept = df
    for _, stage in C.STAGES[:3]:
        kept = stage(spark, kept, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def jaccard(a, b, n):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_between_the_thresholds_leave(docs, spark):
    rng = random.Random(1)
    words, texts = [f"w{i}" for i in range(3000)], []
    for size in (60, 100, 200, 201):
        base = rng.sample(words, size)
        for edits in range(7):
            copy = list(base)
            for at in rng.sample(range(2, size - 2), edits):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    low = list(range(len(texts)))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b], 5) >= 0.8]
    assert sum(jaccard(texts[a], texts[b], 3) < 0.9 for a, b in pairs) >= 5
    for _ in texts:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    kept = C.near_duplicates(spark, docs(texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(low) if c == i]


def texts(rng, n, size=80):
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    return [" ".join(rng.choice(words) for _ in range(size)) for _ in range(n)]


def test_run_matches_brute_force(spark, tmp_path):
    """Every stage by plain Python over the rows the stage before left: verdicts, lines, all pairs, the mix, tiktoken."""
    import base64

    import public_tokenizers
    import tiktoken

    from pitspark.llm import quality_rules as R
    from test_quality_rules import brute_estimate

    rng = random.Random(7)
    clean = texts(rng, 60)
    rows = [(i, t + "\nShared footer of this site" * (i % 3 > 0), "en", f"s{i % 4}", len(t)) for i, t in enumerate(clean)]
    for i in range(12):  # near copies, copies, junk, empty texts, rows without an id and equal rows
        w = clean[i].split()
        w[5 + i] = "changed"
        rows.append((100 + i, " ".join(w), "en", "s1", 0))
    rows += [(200 + i, clean[20 + i], "de", None, 1) for i in range(5)] + [(300 + i, "### " * 60 + t, "en", "s2", 2) for i, t in enumerate(texts(rng, 4))]
    rows += [(400, None, "en", "s1", None), (401, "", "en", "s1", 0), (402, "too short", "en", "s3", 9)] + [(None, texts(rng, 1)[0], "en", "s1", 3)] * 2 + [rows[0]] * 2
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    def votes(m):
        d = dict(zip(R.MEASURES, m))
        n, few = d["n_words"], d["n_words"] < 50
        mean, distinct, letters = d["word_chars"] / n, d["n_distinct"] / n, d["n_letters"] / d["word_chars"]
        part = lambda x, whole, good, bad, least=1: 2 if d[whole] < least else 1 if d[x] / d[whole] <= good else 0 if d[x] / d[whole] >= bad else 2
        return [
            part("n_symbols", "n_words", 0.02, 0.1), part("n_dup_lines", "n_lines", 0, 0.1, 3), part("n_repeat_words", "n_words", 0, 0.1), 1 if letters >= 0.95 else 0 if letters < 0.9 else 2, part("n_upper", "n_letters", 0.04, 0.2),
            2 if few else 1 if 4.4 <= mean <= 6 else 0 if mean < 4.3 or mean > 6.5 else 2, 2 if few or n >= 5000 else 1 if distinct >= 0.6 else 0 if distinct < 0.55 else 2, 0 if few else 1 if n >= 100 else 2,
        ]

    passing = [r for r in rows if (m := R.measure(r[1]))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    docs = [r for r, p in zip(passing, brute_estimate([votes(R.measure(r[1])) for r in passing])) if p >= 0.5]
    pages, lines = {}, {}
    for r in docs:
        pages[r[3]] = pages.get(r[3], 0) + 1
        for line in {x for x in r[1].split("\n") if x.split()}:
            lines[r[3], line] = lines.get((r[3], line), 0) + 1
    drop = {k for k, n in lines.items() if n >= 5 and n > 0.06 * pages[k[0]]}
    assert drop
    cut = ["\n".join(x for x in r[1].split("\n") if (r[3], x) not in drop) for r in docs]
    docs = list({(r[0], t, r[2], r[3], len(t)) for r, t in zip(docs, cut)})
    group, words = list(range(len(docs))), [r[1].lower() for r in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if jaccard(words[a], words[b], 5) >= 0.8]
    for _ in docs:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    first = {}
    for r, g in zip(docs, group):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    docs, size = list(first.values()), lambda r: len(r[1].split())
    assert len(docs) < len(group)
    total, names = {}, sorted({r[3] for r in docs}, key=lambda x: (x is None, x))
    for r in docs:
        total[r[3]] = total.get(r[3], 0) + size(r)
    weight, target, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while free:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    mixed = []
    for s in names:
        whole, before = int(target[s] // total[s]), 0
        place = lambda r: hashlib.md5(("0:" + (str(r[0]) if r[0] is not None else "text " + hashlib.md5(r[1].encode()).hexdigest())).encode()).hexdigest()
        for r in sorted((r for r in docs if r[3] == s), key=place):
            mixed += [r] * (whole + (before + size(r) / 2 <= target[s] - whole * total[s]))
            before += size(r)
    with open(public_tokenizers.path(C.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(r[0] or -1, len(ids), sha(",".join(map(str, ids)).encode()), sha(r[1].encode())) for r in mixed for ids in [bpe.encode_ordinary(r[1])]]
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages_on_edge_cases(docs, spark):
    """Empty tables, null ids and columns, repeated rows, long texts and further columns with clashing names."""
    rng = random.Random(3)
    one, long = texts(rng, 1)[0], " ".join(texts(rng, 1, 40_000))
    rows = [(1, one, "s"), (1, one, "s"), (1, long, None), (None, one, None), (None, one, None), (None, None, None), (2, "", "s"), (2, "### " * 90, "s")]
    wide = docs(rows).selectExpr("*", "1 as row", "2 as kept", "3 as _row", "4 as votes", "5 as lines", "6 as n_lines", "7 as size", "8 as copies", "9 as bucket", "10 as key", "11 as ids")
    left = {"quality rules": 5, "line dedup": 8, "n-gram Jaccard join": 5, "mixing sources to target weights": None}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, wide, "")
        n = len(out.collect())
        assert out.columns == list(C.COLUMNS) and left[name] in (n, None), (name, n)
        assert stage(spark, docs([]), "").collect() == []
    assert len(C.encoding(spark, wide, "").collect()) == 8 and C.encoding(spark, docs([]), "").collect() == []


@pytest.mark.parametrize("pages", [16, 18, 20])
def test_boilerplate_on_a_twelfth_of_a_site_leaves(docs, spark, pages):
    rows = [(i, f"text {i} of site {s}" + "\nCookie notice" * (i % 200 < pages) + "\nchance repeat" * (i % 200 < 9), s) for i, s in ((i, f"s{i // 200}") for i in range(600))]
    out = [r.text for r in C.dedup_lines(spark, docs(rows), "").collect()]
    assert len(out) == 600 and not any("Cookie" in t for t in out)
    assert sum("chance repeat" in t for t in out) == 27


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(f"SELECT {', '.join(columns)} FROM ({Q.ORACLES[name]})")

    def tidy(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    assert tidy(tuple(r) for r in df.select(columns).collect()) == tidy(rel.fetchall())
