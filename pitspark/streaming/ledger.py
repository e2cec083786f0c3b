"""Append-only ledgers and capture windows, in batch and on streams."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import probs as P
from ..operators.selection import first_by


def first_writes(batch: DataFrame, ledger: DataFrame | None, key: str, order: str) -> DataFrame:
    """Rows of a batch whose key is new, the first of each key."""
    new = first_by(batch, [key], F.col(order))
    return new if ledger is None else new.join(ledger.select(key), key, "left_anti")


#: Folders into which a ledger's keys are dealt.
BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def ledger_part(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame | None:
    """What a ledger holds in some of its buckets; only their folders are listed and read. None if it has none of them."""
    if not buckets:
        return None
    try:
        return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/bucket={{{','.join(map(str, sorted(buckets)))}}}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def batch_name(checkpoint: str, number: int) -> str:
    """A batch's folder: streams with different checkpoints may write one ledger."""
    return f"b{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}_{number}"


def append_new(batch: DataFrame, path: str, name: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Write those rows of a batch whose key the ledger does not hold, the first of each key.

    A key's bucket says where it can be, so a batch reads its own keys' buckets, not the ledger. The folder of a bucket and batch
    is replaced when the batch runs again.
    """
    spark = batch.sparkSession
    dealt = batch.withColumn("bucket", bucket_of(F.col(key), buckets))
    mine = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # as many as there are buckets
    ledger = ledger_part(spark, path, mine)
    held = None if ledger is None else ledger.where(F.col("batch") != name).select(key)
    new = first_writes(dealt, held, key, order).withColumn("batch", F.lit(name))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def stream_ledger(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A first-write-wins ledger: what is there already is never written again, a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for its buckets, then for its rows
        try:
            append_new(batch, path, batch_name(checkpoint, number), key, order, buckets)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Statuses of results that count, and seconds by which a source may be later than its forecast.
FINAL, SOURCE_SLACK = "verified_final", 5


def score_rows(predictions: DataFrame, results: DataFrame, scorer: str) -> DataFrame:
    """A row for each prediction and final result of its match: ``reason`` why it is not scored, or score_key, rps and log_loss.

    predictions: match, model, made, source, kickoff (timestamps), p_a, p_draw, p_b. results: match, status, outcome (A, D or B),
    goals_a, goals_b. A key names prediction, result and scorer: the same three always give the same key, a corrected result
    another one.
    """
    p = [F.col(c).cast("double") for c in ("p_a", "p_draw", "p_b")]
    final = results.where(F.col("status") == FINAL).select("match", "outcome", "goals_a", "goals_b", F.lit(True).alias("_final"))
    rows = predictions.join(final, "match", "left")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    simplex = F.abs(p[0] + p[1] + p[2] - 1) <= 1e-6
    reason = F.when(F.col("_final").isNull(), "no_verified_final_result").when(~F.coalesce(F.col("made") < F.col("kickoff"), F.lit(False)), "not_pre_kickoff")
    reason = reason.when(~F.coalesce(seconds("source") <= seconds("made") + SOURCE_SLACK, F.lit(False)), "source_after_prediction").when(~F.coalesce(simplex, F.lit(False)), "invalid_simplex")
    reason = reason.when(~F.coalesce(F.col("outcome").isin("A", "D", "B"), F.lit(False)), "unresolved_outcome")
    text = lambda *c: F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c))
    prediction, result = F.sha2(text("match", "model", "source", "made"), 256), F.sha2(text("match", "outcome", "goals_a", "goals_b"), 256)
    rows = rows.withColumns({"reason": reason, "prediction_id": prediction, "result_hash": F.when(F.col("_final"), result), "scorer": F.lit(scorer)})
    scored = F.col("reason").isNull()
    key = F.when(scored, F.concat_ws("|", "prediction_id", "result_hash", "scorer"))
    rows = rows.withColumns({"score_key": key, "rps": F.when(scored, P.rps(*p, F.col("outcome"))), "log_loss": F.when(scored, P.log_loss(*p, F.col("outcome")))})
    return rows.drop("_final")


def stream_scores(results: DataFrame, predictions: DataFrame, path: str, checkpoint: str, scorer: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A ledger of scores from a stream of results: a result delivered again adds nothing, a corrected one adds a row beside the first."""

    def write(batch: DataFrame, number: int) -> None:
        rows = score_rows(predictions, batch.dropDuplicates(), scorer).where("score_key is not null").persist()
        try:
            append_new(rows, path, batch_name(checkpoint, number), "score_key", "score_key", buckets)
        finally:
            rows.unpersist()

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, horizon: str) -> DataFrame:
    """Each key once within a horizon of event time; bounded state, and it forgets beyond."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(keys))


def event_counts(stream: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts per kind in tumbling windows of event time, late rows up to a bound."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def scored(predictions: DataFrame, results: DataFrame, match: str, made: str, came: str, within: str) -> DataFrame:
    """Predictions joined to results that come within a bound after them, on streams with watermarks or in batch."""
    p, r = predictions.alias("p"), results.alias("r")
    bound = (F.col(f"r.{came}") >= F.col(f"p.{made}")) & (F.col(f"r.{came}") <= F.col(f"p.{made}") + F.expr(f"INTERVAL {within}"))
    return p.join(r, (F.col(f"p.{match}") == F.col(f"r.{match}")) & bound, "left_outer").select("p.*", *(F.col(f"r.{c}") for c in results.columns if c != match))


def window_status(due: Column, captured: Column, now: Column, grace_s: int) -> Column:
    """done, pending, due or missed of a capture window in whole seconds."""
    return F.when(captured.isNotNull(), "done").when(now < due, "pending").when(now <= due + grace_s, "due").otherwise("missed")


def frozen_rows(snapshots: DataFrame, models: dict[str, Sequence[Column]], keys: Sequence[str]) -> DataFrame:
    """A row for each model of each snapshot with its three probabilities."""
    each = [F.struct(F.lit(m).alias("model"), *(c.cast("double").alias(n) for c, n in zip(p, ("pa", "pd", "pb")))) for m, p in models.items()]
    return snapshots.select(*keys, F.explode(F.array(*each)).alias("_m")).select(*keys, "_m.*")
