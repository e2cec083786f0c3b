"""URL filters: given rules first, then association rules mined by FP-growth.

A url's host runs from the first ``://`` up to ``/``, ``?``, ``#`` or its end (A-Z
lower-cased), its path from there up to ``?``, ``#`` or its end; without ``://`` both
are empty. A given rule (host, path prefix) fits its host and all subdomains if the
path starts with the prefix; the longest rule wins.

Where none fits, mined rules judge: pages with labels are baskets of url tokens
(host labels with their depth, path parts, query keys) and, for bad ones (quality 0
or toxic), an item for that. FP-growth finds token combinations that go with it;
those with enough support, confidence and lift, and that hold no shorter such one, block
a url that holds them all. They are matched by an inverted index: a rule stands under
its rarest token, so a token of most urls has few rules or none, and fires if the url has all
its tokens. Each rule holds for ``least_pages`` labelled pages at least and ``min_support`` of them.
Tokens of exactly the same labelled pages are one while mining, so a long url that many
pages share has few combinations, not two to the number of its tokens.

Null urls have empty host and path and are allowed, urls and page ids may repeat or be
null (a row each), labels may be missing or repeat (a page is bad if any of its labels
is). With no labels none is mined; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, LEAST_PAGES = 0.001, 0.5, 1.5, 20
BAD = "label=bad"
#: Summed bytes of urls up to which those that rules fire on are broadcast.
URL_BYTES = 4 << 20


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url: h:label of the host, p:part of the path's words, q:key."""
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path_of(url), r"[/._-]"), lambda x: x.rlike("[a-zA-Z]")), lambda x: F.concat(F.lit("p:"), F.lower(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    return F.array_distinct(F.concat(F.filter(labels, lambda x: x != "h:"), parts, keys))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (length, rule, verdict), null if none fits."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*fits, F.lit(None).cast("struct<length: int, rule: string, verdict: string>"))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(rule_id, tokens, confidence, lift, support) of the combinations that go with bad pages."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = pages.join(bad, pages["page_id"] == bad["doc_id"])
    baskets = known.select(tokens_of(F.col("url")).alias("tokens"), (F.col("bad") == 1).alias("bad")).where("bad or size(tokens) > 0")
    baskets = cut(baskets.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    n = baskets.count()
    empty = "rule_id long, tokens array<string>, confidence double, lift double, support double, needs array<array<string>>"
    if n == 0:
        return pages.sparkSession.createDataFrame([], empty)
    support = max(min_support, min(1.0, least_pages / n))
    classes = cut(token_classes(baskets, -int(-support * n // 1)), "classes")
    stands = small(classes.select("token", F.explode("members").alias("member")))
    merged = baskets.select("basket", F.explode("tokens").alias("member")).join(stands, "member").groupBy("basket").agg(F.collect_set("token").alias("items"))
    items = F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array()))
    rows = cut(baskets.select("basket", "bad").join(merged, "basket", "left").select(items.alias("items")), "items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift))
    rules = pruned(cut(rules.select(F.xxhash64(F.sort_array("antecedent")).alias("rule_id"), F.col("antecedent").alias("tokens"), "confidence", "lift", "support"), "rules"))
    needs = rules.select("rule_id", F.explode("tokens").alias("token")).join(small(classes), "token").groupBy("rule_id").agg(F.collect_list("members").alias("needs"))
    return rules.join(needs, "rule_id")


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, members): tokens of ``least`` baskets at least, those that are in exactly the same baskets as one.

    Without it, a url of 30 tokens that many pages share would have 2 ** 30 combinations of equal support; any of the members says what all say.
    """
    own = F.xxhash64("basket").cast("decimal(38,0)")
    each = baskets.select(F.explode("tokens").alias("token"), own.alias("h")).groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("where")).where(F.col("n") >= least)
    return each.groupBy("n", "where").agg(F.min("token").alias("token"), F.sort_array(F.collect_set("token")).alias("members")).select("token", "members")


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that hold all tokens of a shorter one."""
    one = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    other = one.select(F.col("rule_id").alias("longer"), F.col("need").alias("has"), "token")
    inside = one.join(other, "token").where("need < has").groupBy("rule_id", "need", "longer").agg(F.count("*").alias("found")).where("found = need")
    return rules.join(inside.select(F.col("longer").alias("rule_id")).distinct(), "rule_id", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls on which a mined rule fires, by an inverted index of each rule's rarest token."""
    urls = pages.where("url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    if "needs" not in rules.columns:
        rules = rules.withColumn("needs", F.transform("tokens", lambda t: F.array(t)))
    # what a rule needs: one of the members of each of its classes
    listed = cut(rules.select("rule_id", F.posexplode("needs").alias("at", "one")).select("rule_id", "at", F.explode("one").alias("token")), "listed")
    often = urls.select(F.explode("tokens").alias("token")).join(small(listed.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    counts = listed.join(often, "token", "left").groupBy("rule_id", "at").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.collect_list("token").alias("members"))
    rarest = counts.groupBy("rule_id").agg(F.min_by("members", F.struct("count", "at")).alias("keys"), F.collect_list("members").alias("needs"))
    index = small(cut(rarest.select(F.explode("keys").alias("token"), "needs"), "index"))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.where(F.forall("needs", lambda one: F.arrays_overlap(one, F.col("tokens")))).select("url").distinct()


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, **thresholds) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    fired = cut(matched(judged.where("given is null"), mine(pages, labels, **thresholds)), "fired").withColumn("fires", F.lit("block"))
    # urls have any length: broadcast by their bytes
    short = (fired.agg(F.sum(F.octet_length("url"))).first()[0] or 0) <= URL_BYTES
    out = judged.join((F.broadcast(fired) if short else fired).withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "fires", F.lit("allow")).alias("verdict"))
