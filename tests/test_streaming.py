import datetime
import math
import time

import pytest
from pyspark.sql import functions as F

from pitspark.operators import inplay
from pitspark.streaming import ledger as L
from pitspark.streaming import live


def test_ledger_keeps_the_first_write_and_is_idempotent(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows = lambda data: spark.createDataFrame(data, "key string, n long")
    rows([("a", 1), ("b", 2), ("a", 0)]).write.parquet(source)

    def run(checkpoint):
        L.stream_ledger(spark.readStream.schema("key string, n long").parquet(source), path, checkpoint, "key", "n").awaitTermination()
        return sorted((r.key, r.n) for r in spark.read.parquet(path).collect())

    assert run(str(tmp_path / "c")) == [("a", 0), ("b", 2)]
    rows([("b", -5), ("c", 3)]).write.mode("append").parquet(source)
    assert run(str(tmp_path / "c")) == [("a", 0), ("b", 2), ("c", 3)]
    assert run(str(tmp_path / "c")) == [("a", 0), ("b", 2), ("c", 3)]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    events.union(events.limit(200)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    once = L.deduplicated(stream, ["event_id"], "ts", "400 days")
    name = f"t{int(time.time())}"
    q = once.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table(name).count() == events.count()


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    plain = lambda df: sorted((r["window"].start, r.event_type, r.n) for r in df.collect())
    q = L.event_counts(stream, "ts", "event_type", "1 day", "400 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert plain(spark.table("windows")) == plain(L.event_counts(events, "ts", "event_type", "1 day", "400 days"))


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    when = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    made = spark.createDataFrame([(m, when(100 * m)) for m in range(20)], "match long, made timestamp")
    came = spark.createDataFrame([(m, when(100 * m + d), d) for m in range(20) for d in (-50, 30, 500)], "match long, came timestamp, result long")
    made.write.parquet(str(tmp_path / "p"))
    came.write.parquet(str(tmp_path / "r"))
    batch = sorted((r.match, r.result) for r in L.scored(made, came, "match", "made", "came", "60 SECONDS").collect())
    p, r = (spark.readStream.schema(df.schema).parquet(str(tmp_path / n)).withWatermark(c, "0 seconds") for df, n, c in ((made, "p", "made"), (came, "r", "came")))
    q = L.scored(p, r, "match", "made", "came", "60 SECONDS").writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.match, r.result) for r in spark.table("scores").collect())
    assert batch == [(m, 30) for m in range(20)] and got == batch


@pytest.fixture
def rocks(spark):
    spark.conf.set(live.STORE, live.ROCKS_DB)
    yield spark
    spark.conf.unset(live.STORE)


MATCH = [(1, 7, 3, "goal", "a"), (2, 7, 10, "red", "b"), (3, 7, 20, "goal", "b"), (2, 7, 10, "red", "b"), (4, 8, 15, "goal", "b"), (5, 7, 31, "goal", "a")]
EVENTS = "event_id long, match long, ts timestamp, minute int, kind string, side string"
START = datetime.datetime(2024, 1, 1)


def after(minutes):
    return START + datetime.timedelta(minutes=minutes)


def _one_file(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def _last(rows, key="match"):
    """The last row of each key that a stream in update mode has given."""
    return {r[key]: r for r in rows}


def test_live_records_on_a_stream_equal_a_replay(rocks, tmp_path):
    spark = rocks
    rows = spark.createDataFrame([(i, m, after(t), t, k, s) for i, m, t, k, s in MATCH], EVENTS)
    matches = spark.createDataFrame([(7, 120.0, START + datetime.timedelta(hours=2)), (8, -40.0, START + datetime.timedelta(hours=2))], "match long, delta double, decision_ts timestamp")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    columns = ["match", "minute", "goals_a", "goals_b", "reds_a", "reds_b", "p_a", "p_draw", "p_b"]
    tidy = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in rows)
    seen = []
    q = live.live_records(stream, matches).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    states = inplay.states_at(live.earliest_events(rows).select("match", "minute", "kind", "side"), matches.select("match", "delta"), [15, 31])
    known = states.where("match = 7 AND minute = 31 OR match = 8 AND minute = 15")
    assert tidy(_last(seen).values()) == tidy(inplay.replay(known).collect()) == tidy(live.live_records(rows, matches).collect())
    early = matches.withColumn("decision_ts", F.lit(after(12)))
    with pytest.raises(Exception, match="later than its decision"):
        live.live_records(rows, early).collect()


def test_late_repeated_and_corrected_events_and_the_end_of_a_match(rocks, tmp_path):
    """Deliveries one by one: a repeat adds nothing, an earlier version replaces, a match that ended is gone, and what is too late stays out."""
    spark, path = rocks, str(tmp_path / "in")
    deliveries = [
        [(1, 7, after(3), 3, "goal", "a"), (2, 7, after(9), 9, "goal", "b"), (9, 8, after(8), 8, "red", "a")],
        [(1, 7, after(3), 3, "goal", "a"), (2, 7, after(7), 7, "red", "b"), (3, 7, after(5), None, "goal", "a")],
        [(4, 9, after(400), 1, "goal", "b")],  # event time moves on: 7 and 8 end
        [(5, 7, after(6), 6, "goal", "a"), (6, 9, after(401), 2, "goal", "b")],  # too late for 7
        [(7, 10, after(2000), 5, "other", "a")],
    ]
    schema, seen = spark.createDataFrame([], EVENTS).schema, []
    for n, rows in enumerate(deliveries):
        _one_file(spark.createDataFrame(rows, schema), path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = live.live_states(stream, horizon="10 minutes", keep_minutes=60).writeStream.foreachBatch(lambda df, _: seen.extend((n, r) for r in df.collect()))  # noqa: B023
        q = q.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    told = [(n, r["match"], r["goals_a"], r["goals_b"], r["reds_a"], r["reds_b"], r["minute"], r["ended"]) for n, r in seen]
    before_end = [t for t in told if not t[-1]]
    assert {(7, 1, 1, 0, 0, 9), (8, 0, 0, 1, 0, 8), (7, 2, 0, 0, 1, 7), (9, 0, 1, 0, 0, 1), (9, 0, 2, 0, 0, 2), (10, 0, 0, 0, 0, 5)} == {t[1:-1] for t in before_end}
    ended = {t[1]: t[2:-1] for t in told if t[-1]}
    assert ended == {7: (2, 0, 0, 1, 7), 8: (0, 0, 1, 0, 8), 9: (0, 2, 0, 0, 2)} and len([t for t in told if t[-1]]) == 3
    # what the batch form gives for what was in time
    timely = spark.createDataFrame([r for rows in deliveries for r in rows if r[0] != 5], schema)
    batch = {r["match"]: (r["goals_a"], r["goals_b"], r["reds_a"], r["reds_b"], r["minute"]) for r in live.live_states(timely).collect()}
    assert {m: batch[m] for m in ended} == ended
    # the finished matches hold no state any more
    store = spark.read.format("statestore").option("stateVarName", "sums").load(str(tmp_path / "c"))
    assert {r["key"]["match"] for r in store.select("key").collect()} == {10}


def test_live_states_need_a_store_with_timers(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        live.live_states(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))


def test_a_session_log_on_a_stream(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    schema = "session string, event_key string, event string, at timestamp, due timestamp"
    deliveries = [
        [("s", k, None, after(0), after(30)) for k in ("k1", "k2", "k3")] + [("s", "k1", "captured", after(10), None), ("s", "k1", "captured", after(11), None), ("s", "k4", "skipped", after(12), None)],
        [("s", "k1", "captured", after(20), None), ("s", "k2", "captured", after(34), None), ("t", "k1", "captured", after(34), None)],
        [("s", "k9", "captured", after(100), None)],
        [("s", "k3", "captured", after(101), None), ("s", "k9", "captured", after(102), None)],
        [("s", "z", "captured", after(9000), None)],
        [("s", "z", "captured", after(9001), None)],
    ]
    seen = []
    for rows in deliveries:
        _one_file(spark.createDataFrame(rows, schema), path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = live.session_log(stream, grace_minutes=5, keep_minutes=120).writeStream.foreachBatch(lambda df, _: seen.extend((r.session, r.event_key, r.event) for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = [("s", "k1", "captured"), ("s", "k1", "duplicate"), ("s", "k1", "duplicate"), ("s", "k4", "skipped"), ("s", "k2", "captured"), ("t", "k1", "captured"), ("s", "k9", "captured")]
    want += [("s", "k3", "missed"), ("s", "k3", "duplicate"), ("s", "k9", "duplicate"), ("s", "z", "captured"), ("s", "z", "duplicate")]
    assert sorted(seen) == sorted(want)
    store = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "c"))
    assert {r["key"]["event_key"] for r in store.select("key").collect()} == {"z"}


def test_scores_of_repeated_and_corrected_results(spark, tmp_path):
    path, ledger = str(tmp_path / "in"), str(tmp_path / "scores")
    made = "match long, model string, made timestamp, source timestamp, kickoff timestamp, p_a double, p_draw double, p_b double"
    rows = [(m, x, after(0), after(0), after(60), 0.5, 0.3, 0.2) for m in range(30) for x in ("one", "two")]
    rows += [(100, "late", after(61), after(0), after(60), 0.5, 0.3, 0.2), (101, "ahead", after(0), after(1), after(60), 0.5, 0.3, 0.2), (102, "odd", after(0), after(0), after(60), 0.5, 0.3, 0.3)]
    rows += [(103, "none", after(0), after(0), after(60), None, 0.3, 0.2), (104, "open", after(0), after(0), after(60), 0.5, 0.3, 0.2), (105, "strange", after(0), after(0), after(60), 0.5, 0.3, 0.2), (106, "ok", after(0), after(0) + datetime.timedelta(seconds=5), after(60), 0.5, 0.3, 0.2)]
    predictions = spark.createDataFrame(rows, made)
    result = "match long, status string, outcome string, goals_a int, goals_b int"
    final = [(m, L.FINAL, "ADB"[m % 3], 1, 1) for m in (*range(30), 100, 101, 102, 103, 106)] + [(104, "open", "A", 1, 0), (105, L.FINAL, "X", 0, 0)]
    why = {r.model: r.reason for r in L.score_rows(predictions, spark.createDataFrame(final, result), "v1").collect()}
    assert why == {"one": None, "two": None, "ok": None, "late": "not_pre_kickoff", "ahead": "source_after_prediction", "odd": "invalid_simplex", "none": "invalid_simplex", "open": "no_verified_final_result", "strange": "unresolved_outcome"}

    def deliver(rows, checkpoint="c", scorer="v1"):
        if rows:
            _one_file(spark.createDataFrame(rows, result), path)
        L.stream_scores(spark.readStream.schema(result).parquet(path), predictions, ledger, str(tmp_path / checkpoint), scorer, buckets=8).awaitTermination()
        return spark.read.parquet(ledger)

    assert deliver(final).count() == 61
    assert deliver(final).count() == 61  # the same again
    corrected = deliver([(3, L.FINAL, "D", 2, 2)])
    assert corrected.count() == 63 and {r.outcome for r in corrected.where("match = 3").collect()} == {"A", "D"}
    assert corrected.select("score_key").distinct().count() == 63
    row = corrected.where("match = 3 AND outcome = 'A'").first()
    assert row.rps == pytest.approx((0.25 + 0.04) / 2) and row.log_loss == pytest.approx(math.log(2))
    assert deliver([], checkpoint="other").count() == 63  # all of it from the start
    assert deliver([], checkpoint="new", scorer="v2").count() == 126


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"))
    L.append_new(rows, path, "b0", "key", "n", buckets=16)
    few = rows.limit(2)
    mine = {r[0] for r in few.select(L.bucket_of(F.col("key"), 16)).collect()}
    part = L.ledger_part(spark, path, sorted(mine))
    assert {r[0] for r in part.select("bucket").distinct().collect()} == mine and {int(f.split("bucket=")[1].split("/")[0]) for f in part.inputFiles()} == mine
    L.append_new(few.unionByName(few.withColumn("key", F.concat("key", F.lit("x")))), path, "b1", "key", "n", buckets=16)
    L.append_new(few.unionByName(few.withColumn("key", F.concat("key", F.lit("x")))), path, "b1", "key", "n", buckets=16)
    assert spark.read.parquet(path).count() == 202 and L.ledger_part(spark, str(tmp_path / "none"), [1]) is None


def test_later_events_leave_a_replay_alone(spark):
    e = spark.createDataFrame([(m, t, k, s) for _, m, t, k, s in MATCH], "match long, minute int, kind string, side string")
    m = spark.createDataFrame([(7, 0.0), (8, 0.0), (9, 0.0)], "match long, delta double")
    at = lambda df: {(r.match, r.minute): tuple(r) for r in inplay.replay(inplay.states_at(df, m, [5, 10, 45])).collect()}
    more = e.union(spark.createDataFrame([(7, 11, "goal", "a"), (7, None, "goal", "a"), (9, 46, "goal", "b")], e.schema))
    a, b = at(e), at(more)
    assert all(a[k] == b[k] for k in a if k[1] <= 10 or k[0] > 7) and a[7, 45] != b[7, 45]
    row = next(r for r in inplay.states_at(e, m, [5, 10, 45]).collect() if (r.match, r.minute) == (7, 45))
    assert (row.goals_a, row.goals_b, row.reds_a, row.reds_b) == (2, 1, 0, 2)


def test_market_share_stands_for_a_rating_difference(spark):
    row = spark.range(1).select(inplay.market_delta(F.lit(0.5), F.lit(0.25), F.lit(7.0)), inplay.market_delta(F.lit(None).cast("double"), F.lit(0.25), F.lit(7.0))).first()
    assert abs(row[0] - 400 * math.log10(2)) < 1e-9 and row[1] == 7.0


def test_session_counts(spark):
    log = spark.createDataFrame([("k1", "captured", 1), ("k1", "captured", 2), ("k2", "skipped", 3), ("k1", "captured", 4)], "event_key string, event string, at long")
    expected = spark.createDataFrame([("k1",), ("k3",), ("k4",)], "event_key string")
    assert {r.event: r.n for r in live.session_counts(log, expected).collect()} == {"captured": 1, "skipped": 1, "duplicate": 2, "missed": 2}


def test_window_status(spark):
    df = spark.createDataFrame([(100, None), (100, 105), (900, None), (0, None)], "due long, captured long")
    got = [r[0] for r in df.select(L.window_status(F.col("due"), F.col("captured"), F.lit(120), 30)).collect()]
    assert got == ["due", "done", "pending", "missed"]
