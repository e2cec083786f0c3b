"""Sources: typed readers, header resolution, nested payloads, content-addressed stores and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import first_by


def read_csv(spark: SparkSession, path: str, schema: str, dates: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header and an explicit schema; dates that can't be parsed become null."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumns({c: F.try_to_timestamp(c) for c in dates})


def resolve_headers(df: DataFrame, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """The first header that is there for each target column; fails with the list of all targets without one."""
    found = {t: next((c for c in names if c in df.columns), None) for t, names in candidates.items()}
    missing = [t for t, c in found.items() if c is None]
    if missing:
        raise ValueError(f"no header for: {missing}")
    return df.select(*(F.col(f"`{c}`").alias(t) for t, c in found.items()))


def canonical_names(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Trimmed names, replaced by their canonical one where the alias table has it; null stays null."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_name"))
    out = df.withColumn(column, F.trim(column)).join(known, F.col(column) == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_name", column)).drop("_alias", "_name")


def group_matchday(place: Column) -> Column:
    """Two matches a day within a group: place counts from 1."""
    return F.floor((place - 1) / 2) + 1


def payload_status(payload: Column) -> Column:
    """Why a raw payload can't be stored, null if it can: empty, html, bad_json or not_a_list."""
    text = F.trim(F.coalesce(payload, F.lit("")))
    parsed = F.try_parse_json(text)
    return (
        F.when(text == "", "empty").when(F.lower(text).startswith("<!doctype") | F.lower(text).startswith("<html"), "html")
        .when(parsed.isNull(), "bad_json").when(~text.startswith("["), "not_a_list")
    )


def content_key(payload: Column) -> Column:
    return F.sha2(payload, 256)


def new_objects(payloads: DataFrame, stored: DataFrame, key: str = "sha") -> DataFrame:
    """Payloads whose content is not stored yet, each once: identical bytes are no news."""
    return payloads.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def latest_manifest(manifest: DataFrame, id_col: str, order: str) -> DataFrame:
    return first_by(manifest, [id_col], F.desc(order))


def sentinel(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, reason) of manifest rows (id, sha) without object or with another hash, and of objects without a row."""
    m, o = manifest.select("id", F.col("sha").alias("_m")), objects.select("id", F.col("sha").alias("_o"))
    reason = F.when(F.col("_o").isNull(), "no_object").when(F.col("_m").isNull(), "orphan").when(F.col("_m") != F.col("_o"), "hash_mismatch")
    return m.join(o, "id", "full_outer").select("id", reason.alias("reason")).where("reason IS NOT NULL")


def union_roots(roots: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Roots in their order of precedence: the first that has a key gives its row."""
    tagged = [r.withColumn("_root", F.lit(i)) for i, r in enumerate(roots)]
    out = tagged[0]
    for r in tagged[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return first_by(out, keys, F.col("_root")).drop("_root")


def coverage_gaps(claimed: DataFrame, found: DataFrame, id_col: str, endpoint: str, required: Sequence[str]) -> DataFrame:
    """(id, missing): what claimed ids lack of the required endpoints."""
    have = found.groupBy(id_col).agg(F.collect_set(endpoint).alias("_have"))
    need = F.array(*map(F.lit, required))
    out = claimed.join(have, id_col, "left").withColumn("missing", F.array_sort(F.array_except(need, F.coalesce("_have", F.array().cast("array<string>")))))
    return out.where(F.size("missing") > 0).select(id_col, "missing")


def release_rows(df: DataFrame, approved: DataFrame, cls: str, text: str, allowed: Sequence[str]) -> DataFrame:
    """Rows of approved classes with a hash in place of the text; fails if the text would get out."""
    if text in allowed:
        raise ValueError("raw text must not be released")
    return df.join(approved, cls, "left_semi").select(*allowed, F.sha2(text, 256).alias("content_hash"), F.lit("historical").alias("plane"))
