import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pitspark.llm import url_filter as U


def judge(spark, urls, labels=(), **kw):
    pages = spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("token", F.lit("y"))
    table = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in U.url_filter(pages, table, **kw).collect()}


def test_hosts_paths_and_given_rules(spark):
    urls = ["HTTP://Sub.Example.NET/en/x?a=1#t", "https://example.com/de/", "http://example.com/fr/1", "http://a.org/fr/1", "http://net", "http://net/", "no scheme", None, "http://badexample.net/en/", "x://h?q/://z", "http://É.Net/p#f?g", "http://a.net/e\nn/x", ""]
    out = judge(spark, urls)
    assert [(out[i].host, out[i].path) for i in range(5)] == [("sub.example.net", "/en/x"), ("example.com", "/de/"), ("example.com", "/fr/1"), ("a.org", "/fr/1"), ("net", "")]
    assert [out[i].rule for i in range(9)] == ["example.net/en/", "example.com/de/", None, "org/fr/", None, "net/", None, None, "net/"]
    assert [out[i].verdict for i in range(9)] == ["allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block"]
    assert (out[6].host, out[6].path, out[7].host, out[9].host, out[9].path) == ("", "", "", "h", "")
    assert out[10].host == "É.net" and out[10].path == "/p" and out[11].path == "/e\nn/x"


def test_mined_combinations_block(spark):
    urls = [f"http://{h}.example.com/{p}/{i}" for i, (h, p) in enumerate([("pills", "buy"), ("pills", "news"), ("shop", "buy"), ("blog", "news")] * 40)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 120)] + [(5, None, None), (None, 0, 1)]
    out = judge(spark, urls, labels, min_confidence=0.9, least_pages=5)
    assert {out[i].verdict for i in range(0, 160, 4)} == {"block"}
    assert {out[i].verdict for i in range(160) if i % 4} == {"allow"}


def test_matching_is_the_subset_test(spark):
    urls = ["http://a.b.c/x", "http://b.c/x/y", "http://c/y", "http://c/y"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = spark.createDataFrame([(1, ["h:a", "p:x"]), (2, ["p:y"])], "rule_id long, tokens array<string>")
    assert {r.url for r in U.matched(pages, rules).collect()} == {"http://a.b.c/x", "http://b.c/x/y", "http://c/y"}


def brute_tokens(url):
    host, path, query = re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*", url).groups()
    parts = [f"h:{x}" for x in host.lower().split(".") if x] + [f"p:{x.lower()}" for x in re.split("[/._-]", path) if re.search("[a-zA-Z]", x)]
    return set(parts + [f"q:{x.split('=')[0]}" for x in (query or "").split("&") if x])


def test_mining_matches_brute_force(spark):
    """All token combinations are counted; those with enough support, confidence and lift that hold no shorter one block."""
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['win', 'blog', 'm'])}.{rng.choice('abc')}.com/{rng.choice(['buy', 'news', 'x'])}/{i}?{rng.choice(['ref', 'page'])}=1" for i in range(300)]
    bad = [("win" in u and "buy" in u) or ("ref" in u and "://m.b" in u) or rng.random() < 0.05 for u in urls]
    labels = [(i, int(not bad[i]), 0) for i in range(240)]
    counts, hits = Counter(), Counter()
    for u, b in list(zip(urls, bad))[:240]:
        for n in range(1, 8):
            for c in itertools.combinations(sorted(brute_tokens(u)), n):
                counts[c] += 1
                hits[c] += b
    rate = sum(bad[:240]) / 240
    rules = [set(c) for c in counts if hits[c] >= 5 and hits[c] / counts[c] >= 0.7 and hits[c] / counts[c] / rate >= U.MIN_LIFT]
    rules = [r for r in rules if not any(s < r for s in rules)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    mined = U.mine(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), min_confidence=0.7, least_pages=5).collect()
    assert rules and sorted(sorted(r.tokens) for r in mined) == sorted(map(sorted, rules))
    out = judge(spark, urls, labels, min_confidence=0.7, least_pages=5)
    assert [out[i].verdict == "block" for i in range(300)] == [any(r <= brute_tokens(u) for r in rules) for u in urls]


def test_repeated_and_null_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None), (None, "http://b.com/")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = U.url_filter(pages, labels).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in rows) == [(0, "", "allow"), (0, "b.com", "allow"), (1, "a.net", "block"), (1, "a.net", "block")]


def test_empty_tables(spark):
    assert judge(spark, []) == {}


def test_a_long_url_that_many_pages_share(spark):
    """Forty pages of one url with thirty tokens: one class, and each of its tokens blocks as before."""
    long = "http://bad.example.com/" + "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(28))
    urls = [long] * 40 + [f"http://good.example.com/p{chr(97 + i % 26)}/{i}" for i in range(80)] + ["http://other.example.com/parta/z", "http://other.example.com/z"]
    labels = [(i, int(i >= 40), 0) for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    mined = U.mine(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(mined) == 1 and len(mined[0].needs[0]) == 29  # all but example and com
    out = judge(spark, urls, labels)
    assert [i for i in range(len(urls)) if out[i].verdict == "block"] == [*range(40), 120]
