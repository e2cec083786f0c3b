"""Readers of the shared tables, with a clock in whole seconds where events are ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, the session being in UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (match, idx, t, kind, x, k): a user is a match, t its clock, x a chance's quality, k a nested part."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("match"), F.col("event_id").alias("idx"), seconds(F.col("ts")).alias("t"),
        F.col("event_type").alias("kind"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: The same view for DuckDB.
CLOCKED_SQL = """e AS (SELECT user_id AS match, event_id AS idx, epoch_us(ts) // 1000000 AS t, event_type AS kind, value AS x, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
