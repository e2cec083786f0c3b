"""Windows and panels: ties of rounding as in their SQL, and partitions that grow with the rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pitspark.operators import history as H
from pitspark.operators import pit
from pitspark.plans import ORACLES, QUERIES


def test_momentum_rounds_ties_as_its_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql("""CREATE TABLE made AS SELECT 2 * u + i AS event_id, u::BIGINT AS user_id, TIMESTAMP '2024-01-02 00:00:00' AS ts, CASE i WHEN 0 THEN 'click' ELSE 'purchase' END AS event_type,
        0.36 + 0.72 * u AS value, '{"k": 2}' AS props FROM range(60) a(u), range(2) b(i)""")
    con.sql(f"COPY (SELECT * REPLACE (value::DOUBLE AS value) FROM made) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    columns = ["match", "t", "xg_last_86400_home", "xg_momentum", "xg_acceleration"]
    got = sorted(tuple(r) for r in QUERIES["win8_rolling_windows"](spark, str(tmp_path)).select(*columns).collect())
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['win8_rolling_windows']})").fetchall())
    assert len(got) == 60 and got == want


@pytest.mark.parametrize("make", ["windows", "panel"])
def test_partitions_grow_with_the_rows(spark, monkeypatch, make):
    events = spark.range(600).select((F.col("id") % 40).alias("match"), (F.col("id") * 7).alias("t"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 2 == 0, "home").otherwise("away")).alias("side"), (F.col("id") % 5).cast("double").alias("x"))
    asked = spark.range(40).select(F.col("id").alias("match"), F.lit(3000).cast("long").alias("t"))

    def run():
        if make == "windows":
            return H.rolling_sides(events, asked, {"x": F.col("x")}, [(0, 900), (900, 1800)], lambda t: (t >= 1000).cast("int"))
        return pit.side_panel(events, asked, {"x": F.col("x")}, F.col("x") == 4, [600], [("x", 900)])

    few = sorted(map(str, run().collect()))
    monkeypatch.setattr(pit, "ROWS", 20)
    many = run()
    assert many.rdd.getNumPartitions() >= 30
    assert sorted(map(str, many.collect())) == few
