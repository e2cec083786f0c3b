"""Queries of sources, stores, manifests and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pit
from ..sources import nested as N
from ..sources import readers as S
from ..sources.tables import CLOCKED_SQL, clocked, table
from ..streaming import ledger as L
from .function_queries import FORECAST_SQL, forecasts
from .registry import Registry

query = Registry()


@query("src3_src4_header_resolution", "SELECT 'intl_' || (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::VARCHAR AS match_id, o_custkey AS team_a, o_orderstatus AS result FROM orders")
def src3(spark, sf_dir):
    """Ids in the order of the days: the rows of the days before, counted once a day, and the place within the day."""
    o = table(spark, sf_dir, "orders")
    r = S.resolve_headers(o, {"kickoff": ["date", "o_orderdate"], "team_a": ["home", "o_custkey"], "result": ["o_orderstatus"], "id": ["o_orderkey"]})
    days = r.groupBy("kickoff").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("kickoff").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.join(days.select(F.col("kickoff").alias("_day"), before.alias("_before")), F.col("kickoff") == F.col("_day"))
    n = F.col("_before") + F.row_number().over(Window.partitionBy("kickoff").orderBy("id")) - 1
    return r.select(F.concat(F.lit("intl_"), n.cast("string")).alias("match_id"), "team_a", "result")


@query("src5_canonical_names", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Machines' WHEN 'BUILDING' THEN 'Houses' ELSE c_mktsegment END AS segment FROM customer")
def src5(spark, sf_dir):
    aliases = spark.createDataFrame([("MACHINERY", "Machines"), ("BUILDING", "Houses")], "alias string, canonical string")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("segment"))
    return S.canonical_names(c, aliases, "segment")


@query("src6_matchday", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 2 + 1 AS matchday FROM orders")
def src6(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.group_matchday(place).alias("matchday"))


@query("src8_payload_validation", "SELECT CASE WHEN trim(html) = '' THEN 'empty' WHEN starts_with(lower(trim(html)), '<!doctype') OR starts_with(lower(trim(html)), '<html') THEN 'html' ELSE 'bad_json' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def src8(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.coalesce(S.payload_status(F.col("html")), F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


@query("src7_content_addressed_store", "WITH p AS (SELECT sha256(text) AS sha, doc_id FROM documents WHERE text IS NOT NULL), st AS (SELECT DISTINCT sha FROM p WHERE doc_id % 2 = 0) SELECT DISTINCT sha FROM p WHERE sha NOT IN (SELECT sha FROM st)")
def src7(spark, sf_dir):
    """Texts that half of the documents, taken as stored, do not have."""
    p = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", S.content_key(F.col("text")).alias("sha"))
    return S.new_objects(p, p.where("doc_id % 2 = 0").select("sha").distinct()).select("sha")


@query("src9_sentinel", "WITH m AS (SELECT o_orderkey AS id, o_custkey % 7 AS sha FROM orders WHERE o_orderkey % 3 > 0), o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE o_custkey % 7 END AS sha FROM orders WHERE o_orderkey % 5 > 0) SELECT coalesce(m.id, o.id) AS id, CASE WHEN o.sha IS NULL THEN 'no_object' WHEN m.sha IS NULL THEN 'orphan' ELSE 'hash_mismatch' END AS reason FROM m FULL JOIN o ON m.id = o.id WHERE o.sha IS NULL OR m.sha IS NULL OR m.sha <> o.sha")
def src9(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("sha"))
    objects = o.where("id % 5 > 0").withColumn("sha", F.when(F.col("id") % 11 == 0, 99).otherwise(F.col("sha")))
    return S.sentinel(o.where("id % 3 > 0"), objects)


@query("src10_latest_manifest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1")
def src10(spark, sf_dir):
    return S.latest_manifest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("src11_union_of_roots", "SELECT c_custkey AS id, 'first' AS root FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 > 0")
def src11(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return S.union_roots([c.where("id % 2 = 0").withColumn("root", F.lit("first")), c.where("id % 3 = 0").withColumn("root", F.lit("second"))], ["id"])


@query("src12_coverage_gaps", f"WITH {CLOCKED_SQL}, h AS (SELECT match, list(DISTINCT kind) AS have FROM e WHERE t < 1704400000 GROUP BY match), c AS (SELECT DISTINCT match FROM e), g AS (SELECT c.match, list_sort(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(coalesce(have, []), x))) AS missing FROM c LEFT JOIN h USING (match)) SELECT match, missing FROM g WHERE len(missing) > 0")
def src12(spark, sf_dir):
    e = clocked(spark, sf_dir)
    return S.coverage_gaps(e.select("match").distinct(), e.where("t < 1704400000"), "match", "kind", ["click", "purchase", "view"])


@query("src14_canonical_events", f"WITH {CLOCKED_SQL} SELECT match, idx, CASE kind WHEN 'purchase' THEN 'shot' WHEN 'error' THEN 'foul' WHEN 'view' THEN 'pass' ELSE 'other' END AS kind, t % 5400 AS clock_s, CASE WHEN t % 5400 < 2700 THEN 1 ELSE 2 END AS period, k FROM e")
def src14(spark, sf_dir):
    """Provider events with a nested part as canonical rows: mapped kind, clock, period."""
    kinds = F.create_map(*(F.lit(x) for x in ("purchase", "shot", "error", "foul", "view", "pass")))
    e = clocked(spark, sf_dir)
    return e.select("match", "idx", F.coalesce(kinds[F.col("kind")], F.lit("other")).alias("kind"), (F.col("t") % 5400).alias("clock_s"), F.when(F.col("t") % 5400 < 2700, 1).otherwise(2).alias("period"), "k")


@query("src20_catalogue", "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY source")
def src20(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct(F.sha2("text", 256)).alias("contents"))


@query("src23_release", "SELECT doc_id, lang, sha256(text) AS content_hash, 'historical' AS plane FROM documents WHERE lang IN ('en', 'de')")
def src23(spark, sf_dir):
    approved = spark.createDataFrame([("en",), ("de",)], "lang string")
    return S.release_rows(table(spark, sf_dir, "documents"), approved, "lang", "text", ["doc_id", "lang"])


@query("str1_first_write_wins", f"WITH {CLOCKED_SQL}, n AS (SELECT *, match * 1000 + k AS key FROM e), l AS (SELECT key FROM n WHERE t < 1705276800), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS rn FROM n WHERE t >= 1705276800) SELECT key, idx FROM r WHERE rn = 1 AND key NOT IN (SELECT key FROM l)")
def str1(spark, sf_dir):
    """SRC19 and STR1: what a second delivery adds to a ledger."""
    n = clocked(spark, sf_dir).withColumn("key", F.col("match") * 1000 + F.col("k"))
    return L.first_writes(n.where("t >= 1705276800"), n.where("t < 1705276800").select("key").distinct(), "key", "idx").select("key", "idx")


@query("str3_capture_windows", f"WITH {CLOCKED_SQL}, c AS (SELECT match, min(t) AS captured FROM e WHERE kind = 'purchase' AND t >= 1705276800 GROUP BY match), w AS (SELECT unnest([1705276800, 1705500000, 1706000000]) AS due), m AS (SELECT DISTINCT match FROM e) SELECT m.match, w.due::BIGINT AS due, CASE WHEN c.captured <= w.due + 600 THEN 'done' WHEN 1705500300 < w.due THEN 'pending' WHEN 1705500300 <= w.due + 600 THEN 'due' ELSE 'missed' END AS status FROM m CROSS JOIN w LEFT JOIN c ON c.match = m.match")
def str3(spark, sf_dir):
    e = clocked(spark, sf_dir)
    c = e.where("kind = 'purchase' AND t >= 1705276800").groupBy("match").agg(F.min("t").alias("captured"))
    m = e.select("match").distinct().join(c, "match", "left").withColumn("due", F.explode(F.array(*(F.lit(x).cast("long") for x in (1_705_276_800, 1_705_500_000, 1_706_000_000)))))
    seen = F.when(F.col("captured") <= F.col("due") + 600, F.col("captured"))
    return m.select("match", "due", L.window_status(F.col("due"), seen, F.lit(1_705_500_300), 600).alias("status"))


@query("str2_str7_scored_predictions", "SELECT o_orderkey, l_linenumber, l_quantity AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY")
def str7(spark, sf_dir):
    """Predictions with results that come within sixty days of them."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match"), "o_orderdate")
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match"), "l_shipdate", "l_linenumber", F.col("l_quantity").alias("result"))
    return L.scored(p, r, "match", "o_orderdate", "l_shipdate", "60 DAY").select(F.col("match").alias("o_orderkey"), "l_linenumber", "result")


@query("str9_frozen_models", f"WITH {FORECAST_SQL} SELECT l_orderkey, l_linenumber, m AS model, CASE m WHEN 'raw' THEN pa ELSE 0.75 * pa + 0.25 / 3 END AS pa FROM p, (VALUES ('raw'), ('blend')) v(m)")
def str9(spark, sf_dir):
    p = [F.col(c) for c in ("pa", "pd", "pb")]
    rows = L.frozen_rows(forecasts(spark, sf_dir), {"raw": p, "blend": [0.75 * c + 0.25 / 3 for c in p]}, ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", "model", "pa")


@query("src13_nested_odds", "SELECT l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS book, max(1 + l_quantity) AS home, max(1 + l_discount) AS draw, CASE WHEN count(*) > 1 THEN max(1 + l_tax) END AS away FROM lineitem GROUP BY ALL")
def src13(spark, sf_dir):
    """Odds payloads, made from the lines of an order, flattened to a row a book."""
    book = F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd")
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", book.alias("book")).agg(F.max(1 + F.col("l_quantity")).alias("h"), F.max(1 + F.col("l_discount")).alias("d"), F.max(1 + F.col("l_tax")).alias("a"), F.count("*").alias("n"))

    def price(name, c):
        return F.struct(F.lit(name).alias("name"), c.alias("price"))

    outcomes = F.array_compact(F.array(price("H", F.col("h")), price("D", F.col("d")), F.when(F.col("n") > 1, price("A", F.col("a")))))
    markets = F.array(F.struct(F.lit("1x2").alias("market"), outcomes.alias("outcomes")), F.struct(F.lit("total").alias("market"), F.array(price("over", F.lit(1.9))).alias("outcomes")))
    payloads = each.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("book", markets.alias("markets"))).alias("books"))).alias("payload"))
    return N.flatten_odds(payloads, "l_orderkey", F.col("payload"), "1x2", ("H", "D", "A"))


@query("src15_src16_lineups", "SELECT l_orderkey, o_custkey AS team, l_suppkey AS player, l_returnflag AS pos, l_linenumber <= 3 AS starts FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def src15(spark, sf_dir):
    """Lineup payloads, made from orders, flattened to starters and bench."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = pit.dealt(lines, "l_orderkey", [lines]).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    one = F.struct(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("pos"))
    starts = F.col("l_linenumber") <= 3
    p = j.groupBy("l_orderkey", "o_custkey").agg(F.collect_list(F.when(starts, one)).alias("startXI"), F.collect_list(F.when(~starts, one)).alias("substitutes"))
    p = p.select("l_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("team"), "startXI", "substitutes")).alias("payload"))
    return N.lineup_players(p, "l_orderkey", F.col("payload"))
