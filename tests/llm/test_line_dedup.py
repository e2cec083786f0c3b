import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitspark.llm import line_dedup as D
from pitspark.llm.line_dedup import line_dedup
from pitspark.llm.url_filter import host_of


def brute(rows, ratio=0.06, least=5):
    pages, lines = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        lines.update((s, x) for x in set((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x))
    drop = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, t, s in rows:
        kept = None if t is None else [x for x in t.split("\n") if (s, x) not in drop]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hashes", [D.HASHES, 0])
def test_matches_brute_force(docs, monkeypatch, hashes):
    monkeypatch.setattr(D, "HASHES", hashes)
    rng = random.Random(0)
    common = ["cookie notice", "share this", "é menu", "", "  ", "\t", " \r"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.3 else f"line {rng.randint(0, 500)}" for _ in range(rng.randint(1, 8))), rng.choice(["a", "b", None])) for i in range(200)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "share this\nshare this", "a"), (903, "x\n" * 5000, "a"), (904, "share this", "other")]
    df = docs(rows).withColumn("line", F.lit(1)).withColumn("lines", F.lit(2)).withColumn("site", F.lit("z")).withColumn("row", F.lit(3)).withColumn("n_lines", F.lit(4))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(df).collect()), key=str) == brute(rows)


def test_sites_by_host(spark):
    rows = [(f"http://A.example.com/{i}", f"page {i}\nAll rights reserved") for i in range(20)] + [(f"http://b.org/{i}", f"text {i}") for i in range(20)] + [("http://b.org/x", "All rights reserved")]
    out = line_dedup(spark.createDataFrame(rows, "url string, text string"), host_of(F.col("url"))).collect()
    assert sum(r.n_dropped for r in out) == 20 and {r.text for r in out if "b.org/x" in r.url} == {"All rights reserved"}


def test_repeated_and_null_rows_are_pages(docs):
    rows = [(1, "same\nline", "s")] * 6 + [(None, "same\nother", "s")] * 2
    out = line_dedup(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "other")] * 2 + [(1, "")] * 6


def test_empty_table(docs):
    assert line_dedup(docs([])).count() == 0
