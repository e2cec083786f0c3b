"""Joins of sources: bridges, cascades, band joins, mutual matches, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bridge(a: DataFrame, b: DataFrame, keys: Sequence[str], id_col: str, score: str) -> DataFrame:
    """(a, b, status) for every row of a: matched one to one with equal score, else why not."""
    keys = list(keys)
    left = a.select(*keys, F.col(id_col).alias("a"), F.col(score).alias("_sa"))
    right = b.select(*keys, F.col(id_col).alias("b"), F.col(score).alias("_sb"))
    # a row a key: no pair of a's and b's rows is made, as a key may have many of either
    theirs = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("b").alias("b"), F.min("_sb").alias("_sb"))
    ours = left.groupBy(*keys).agg(F.count("*").alias("_m"))
    # the only one of its key on both sides may still be listed elsewhere: its partners are counted over all its keys
    met = right.join(ours, keys).select("b", "_m", *keys)
    alone = theirs.join(ours, keys).where("_n = 1 and _m = 1").select("b").distinct()
    taken = met.join(alone, "b", "left_semi").groupBy("b").agg(F.sum("_m").alias("_t")).where("_t > 1").select(F.col("b").alias("_b"), F.lit(True).alias("_taken"))
    theirs = theirs.join(ours, keys, "left").join(taken, F.col("b") == F.col("_b"), "left").drop("_b")
    theirs = theirs.select(*keys, "_n", "b", "_sb", ((F.col("_n") > 1) | (F.col("_m") > 1) | F.coalesce("_taken", F.lit(False))).alias("_many"))
    rows = left.join(theirs, keys, "left")
    g = rows.groupBy("a").agg(F.sum(F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))).alias("_na"), F.min("b").alias("b"), F.bool_or("_many").alias("_many"), F.bool_or(F.col("_sa") != F.col("_sb")).alias("_differs"))
    status = F.when(F.col("b").isNull(), "no_partner").when((F.col("_na") > 1) | F.col("_many"), "ambiguous").when(F.col("_differs"), "score_differs").otherwise("matched")
    return g.select("a", "b", status.alias("status"))


def mapping_cascade(left: DataFrame, right: DataFrame, id_col: str, name: str, other_id: str, other_name: str) -> DataFrame:
    """Ids by exact name, else by the only lower-cased one, else ambiguous or missing; a row of left stays one row.

    A name that several ids bear exactly is ambiguous too.
    """
    exact = right.groupBy(F.col(other_name).alias("_n")).agg(F.min(other_id).alias("_e"), F.count("*").alias("_m"))
    low = right.groupBy(F.lower(other_name).alias("_l")).agg(F.min(other_id).alias("_u"), F.count("*").alias("_c"))
    j = left.join(exact, left[name] == exact["_n"], "left").join(low, F.lower(left[name]) == low["_l"], "left")
    how = F.when(F.col("_m") == 1, "exact").when(F.col("_m") > 1, "ambiguous").when(F.col("_c") == 1, "normalised").when(F.col("_c") > 1, "ambiguous").otherwise("missing")
    j = j.withColumn("how", how)
    return j.withColumn(other_id, F.when(F.col("how") == "exact", F.col("_e")).when(F.col("how") == "normalised", F.col("_u"))).drop("_n", "_e", "_m", "_l", "_u", "_c")


def band_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, width: int) -> DataFrame:
    """Pairs of equal keys whose clocks differ by width at most: an equi-join on buckets of that width and its neighbours."""
    rows = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col(lt) / width) + d for d in (-1, 0, 1)))))
    other = right.withColumn("_b", F.floor(F.col(rt) / width))
    return rows.join(other, [*keys, "_b"]).where(F.abs(F.col(lt) - F.col(rt)) <= width).drop("_b")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, right_id: str, width: int) -> DataFrame:
    """Each row of left with the number of hits and the nearest, ties to the smaller id."""
    found = band_pairs(left, right, keys, lt, rt, width).groupBy(*left.columns)
    found = found.agg(F.count("*").alias("hits"), F.min_by(right_id, F.struct(F.abs(F.col(lt) - F.col(rt)), right_id)).alias("nearest"))
    return left.join(found, left.columns, "left").na.fill(0, ["hits"])


def mutual_nearest(a: DataFrame, b: DataFrame, keys: Sequence[str], ta: str, tb: str, ia: str, ib: str, width: int) -> DataFrame:
    """Pairs that are each other's nearest; every row is used once at most."""
    gap = F.abs(F.col(ta) - F.col(tb))
    pairs = band_pairs(a, b, keys, ta, tb, width)
    pairs = pairs.withColumns({"_ra": F.row_number().over(Window.partitionBy(ia).orderBy(gap, ib)), "_rb": F.row_number().over(Window.partitionBy(ib).orderBy(gap, ia))})
    return pairs.where("_ra = 1 AND _rb = 1").drop("_ra", "_rb")


def resolve_aliases(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    known = aliases.select(F.col("alias").alias("_alias"), "identity")
    return df.join(known, df[column] == known["_alias"], "left").drop("_alias")


def confidence(pairs: DataFrame, same_type: Column, same_team: Column, gap: Column, width: float, corrected: Column | None = None, live_safe: Column | None = None) -> DataFrame:
    """0.4 for the type, 0.3 for the team, 0.3 for the clock, falling to 0 at the width; fixed values: high from 0.75, medium from 0.5."""

    def yes(x: Column) -> Column:
        return F.coalesce(x, F.lit(False)).cast("int")

    clock = F.coalesce(F.greatest(F.lit(0.0), 1 - gap / float(width)), F.lit(0.0))
    total = F.least(F.lit(1.0), 0.4 * yes(same_type) + 0.3 * yes(same_team) + 0.3 * clock)
    pairs = pairs.withColumn("confidence", F.floor(total * 1000 + 0.5) / 1000.0)  # three places
    c = F.col("confidence")
    flags = F.when(F.lit(False) if corrected is None else corrected, "correction_or_duplicate").when(F.lit(False) if live_safe is None else ~live_safe, "timing_not_safe_for_live_use")
    kind = flags.when(c >= 0.75, "high_confidence_event_alignment").when(c >= 0.5, "medium_confidence_event_alignment").when(c > 0, "low_confidence_event_alignment")
    return pairs.withColumn("class", kind.otherwise("unaligned"))


def plain_name(name: Column) -> Column:
    """Lower case, letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N} ]", ""))


def _edits(length: Column, least: float) -> Column:
    """The edits that two names, the longer one of this length, have at most if they are similar enough."""
    return F.floor((1 - least) * length + 1e-9).cast("int")


def _shared_least(most: int, q: int, least: float) -> int:
    """How many grams two similar names share at least, the longer one having ``most`` letters: an edit takes q of them."""
    return most - q + 1 - q * math.floor((1 - least) * most + 1e-9)


def _prefixes(least: float, longest: int) -> list[tuple[int, int, int, int]]:
    """(q, length, lowest length of a pair's longer name, grams shared at least): which names go into which index.

    Pairs whose longer name has enough letters that two of them must stand together somewhere are found by pairs of
    letters, the others by single ones, of which similar names always share some.
    """
    low = next((m for m in range(2, longest + 1) if all(_shared_least(x, 2, least) > 0 for x in range(m, longest + 1))), longest + 1)
    out = []
    for length in range(1, longest + 1):
        top = min(longest, math.floor(length / least + 1e-9))
        if length < low:
            out.append((1, length, 1, min(_shared_least(m, 1, least) for m in range(length, min(top, low - 1) + 1))))
        if top >= low and length >= 2:
            out.append((2, length, low, min(_shared_least(m, 2, least) for m in range(max(length, low), top + 1))))
    return out


def name_candidates(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(_r, _k) of distinct plain names that may be as similar as ``least``: none that is, is missing.

    Each name is listed under its rarest grams only, so many that two names which share as many grams as similar ones must have one of
    these in common (a prefix of the grams by rarity). Of the pairs found there, lengths must fit, the gram must stand within as
    many places as there may be edits, and the grams shared in all must be enough.
    """
    longest = max((df.agg(F.max(F.length(c))).first()[0] or 0 for df, c in ((asked, "_r"), (known, "_k"))), default=0)
    plan = asked.sparkSession.createDataFrame(_prefixes(least, longest), "_q int, _len int, _from int, _c int")  # two rows a length
    plan = F.broadcast(plan)

    def grams(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(name, F.length(name).alias("_len")).join(plan, "_len")
        every = F.transform(F.sequence(F.lit(1), F.col("_len") - F.col("_q") + 1), lambda i: F.struct(F.substring(F.col(name), i, F.col("_q")).alias("g"), i.alias("i")))
        return rows.select(name, "_len", "_q", "_c", every.alias("_all"))

    k, r = grams(known, "_k"), grams(asked, "_r")
    often = written(k.select("_q", F.explode("_all").alias("x")).groupBy("_q", F.col("x.g").alias("g")).agg(F.count("*").alias("n")))

    def listed(df: DataFrame, name: str) -> DataFrame:
        """Names by their rarest grams; a gram that no known name has is rarest of all."""
        each = df.select(name, "_len", "_q", "_c", F.size("_all").alias("_n"), F.explode("_all").alias("x")).select(name, "_len", "_q", "_c", "_n", "x.*").join(often, ["_q", "g"], "left")
        order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g", "i")))
        short = each.groupBy(name, "_len", "_q", "_c", "_n").agg(order.alias("_o")).withColumn("_o", F.slice("_o", F.lit(1), F.greatest(F.lit(0), F.col("_n") - F.col("_c") + 1)))
        return short.select(name, F.col("_len").alias(f"{name}_len"), "_q", F.explode("_o").alias("x")).select(name, f"{name}_len", "_q", "x.g", F.col("x.i").alias(f"{name}_i"))

    most = F.greatest("_r_len", "_k_len")
    near = (F.abs(F.col("_r_i") - F.col("_k_i")) <= _edits(most, least)) & (F.abs(F.col("_r_len") - F.col("_k_len")) <= _edits(most, least))
    pairs = listed(r, "_r").join(listed(k, "_k"), ["_q", "g"]).where(near).select("_q", "_r", "_k").distinct()
    # the count filter, with each occurrence of a gram once
    numbered = lambda x: F.transform(x, lambda e: F.concat(e["g"], F.size(F.filter(x, lambda o: (o["g"] == e["g"]) & (o["i"] < e["i"]))).cast("string")))
    own = lambda df, name: df.select("_q", name, numbered(F.col("_all")).alias(f"{name}_g"))
    both = pairs.join(own(r, "_r"), ["_q", "_r"]).join(own(k, "_k"), ["_q", "_k"])
    longer = F.greatest(F.length("_r"), F.length("_k"))
    enough = F.size(F.array_intersect("_r_g", "_k_g")) >= longer - F.col("_q") + 1 - F.col("_q") * _edits(longer, least)
    return both.where(enough).select("_r", "_k").distinct()


def resolve_entities(raw: DataFrame, known: DataFrame, id_col: str, raw_col: str, name: str, least: float) -> DataFrame:
    """(id, entity): the known name whose plain form is nearest by edit distance, if similar enough (``least``, above 0); ties to the greatest name.

    Only candidates of the gram index are compared (``name_candidates``). Equal plain names are one.
    """
    known = known.select(F.col(name).alias("_name"), plain_name(F.col(name)).alias("_k")).groupBy("_k").agg(F.max("_name").alias("_name")).where("_k <> ''")
    left = raw.select(id_col, plain_name(F.col(raw_col)).alias("_r"))
    pairs = name_candidates(left.select("_r").distinct().where("_r <> ''"), known.select("_k"), least).join(known, "_k")
    longer = F.greatest(F.length("_r"), F.length("_k"))
    apart = F.levenshtein("_r", "_k")
    best = pairs.groupBy("_r").agg(F.max(F.struct((1 - apart / longer).alias("c"), F.col("_name").alias("n"))).alias("_best"))
    out = left.join(best.withColumnRenamed("_r", "_q"), F.col("_r") == F.col("_q"), "left")
    return out.select(id_col, F.when(F.col("_best.c") >= least, F.col("_best.n")).alias("entity"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, cut off from its lineage by a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of undirected pairs (a, b): the smallest node that is reached.

    Labels spread along edges and then jump to their label's label, so that long chains
    take few rounds; each round is written, so it is not computed again.
    """
    edges = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        step = written(step)
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("next"))
        new = written(step.join(jump, "c").select("node", "old", F.least("c", "next").alias("component")))
        if not new.where("old <> component").take(1):
            return new.select("node", "component")
        labels = new.select("node", "component")
