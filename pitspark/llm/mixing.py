"""Mix sources to target weights by capped water-filling.

The words of all sources are shared out by weight. A source takes at most
``max_epochs`` times its words; what is over goes to the others in proportion to
their weights, again and again, until none is above its cap. That fixed point is
found in one pass over the sources in the order in which they reach their caps.
A source's target is then whole repetitions of all its rows and, for the rest, the
rows that come first in a seeded order, as far as the rest reaches (the last row
is in if more than half of it fits).

A running sum in the seeded order takes no source into one task: rows fall into
buckets of that order, as many as the table's rows call for, buckets are summed first,
and each bucket is ordered by itself. Sources are few: their fixed point is found in one
task, from one row each.

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating. Null
and blank texts have size 0. Rows with equal ids are ordered by size, rows without id by
a hash of their text; equal rows are as good as each other. An empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

#: About so many rows of a source of the whole table's size fall into a bucket of the seeded order.
BUCKET_ROWS = 1 << 14


def water_fill(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds weight and target to (source, source_size), one row for each source."""
    every = Window.partitionBy(F.lit(1))  # one row a source
    ranked = sizes.withColumn("weight", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", max_epochs * F.col("source_size"))
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("place", F.row_number().over(order)).withColumn("level", left / F.sum("weight").over(onward))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)
    target = F.when(F.col("place") < F.col("free.place"), F.col("cap")).otherwise(F.col("free.level") * F.col("weight"))
    return ranked.withColumn("free", free).select("source", "source_size", "weight", F.least(F.coalesce(target, "cap"), "cap").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies (how often the mix takes it) and taken (words); with ``keep``, those columns instead of the id."""
    place = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), place)).alias("at"),
        *(F.struct(*keep).alias("kept") for _ in keep[:1]),
    )
    if not keep:
        rows = cut(rows, "sizes")
    digits = math.ceil(math.log(max(rows.count() / BUCKET_ROWS, 1), 16))
    rows = rows.withColumn("bucket", F.substring("at", 1, digits))
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = cut(water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs), "targets")
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(buckets.select("source", "bucket", start.alias("start")), "starts").withColumnsRenamed({"source": "s", "bucket": "b"})
    inner = Window.partitionBy("source", "bucket").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(small(starts), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left").drop("s", "b")
    targets = small(targets).withColumnRenamed("source", "s")
    mixed = placed.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    mixed = mixed.withColumn("whole", whole)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    more = F.when((F.col("size") > 0) & (F.col("start") + F.col("before") + F.col("size") / 2 <= rest), 1).otherwise(0)
    mixed = mixed.withColumn("copies", (F.col("whole") + more).cast("long"))
    own = [F.col(f"kept.`{c}`") for c in keep] or [F.col("id").alias(id_col)]
    return mixed.select(*own, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
