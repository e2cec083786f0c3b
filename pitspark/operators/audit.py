"""Audits of features and forecasts: one row a check, with what was seen and how often it was broken."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a regulation snapshot may not lie beyond, and how far probabilities may be from one in sum.
LAST_PERIOD, LAST_MINUTE, SUM_TOLERANCE = 2, 90.0, 1e-6

Check = tuple[str, Column]


def simplex(p: Sequence[str], tolerance: float = SUM_TOLERANCE) -> Column:
    """Every probability within 0 and 1, and their sum one; null is a breach."""
    each = [F.col(c).between(-1e-9, 1 + 1e-9) for c in p]
    total = sum((F.col(c) for c in p[1:]), F.col(p[0]))
    ok = F.abs(total - 1) <= tolerance
    for x in each:
        ok = ok & x
    return F.coalesce(ok, F.lit(False))


def regulation(period: str | None = None, minute: str | None = None) -> Column:
    """Within the two halves and ninety minutes; unknown is no breach."""
    ok = F.lit(True)
    if period:
        ok = ok & (F.col(period).isNull() | (F.col(period) <= LAST_PERIOD))
    if minute:
        ok = ok & (F.col(minute).isNull() | (F.col(minute) <= LAST_MINUTE + 1e-6))
    return ok


def measured(df: DataFrame, checks: Sequence[Check], families: dict[str, Sequence[str]] | None = None) -> dict[str, int]:
    """Rows, breaches of row checks, and how many of each family's cells are known, from one pass over the columns that these need."""
    sums = [F.count(F.lit(1)).alias("rows")] + [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"check:{n}") for n, ok in checks]
    for family, columns in (families or {}).items():
        sums += [F.count(c).alias(f"known:{family}:{c}") for c in columns]
    return df.agg(*sums).first().asDict()


def leaked_targets(make: Callable[[DataFrame], DataFrame], source: DataFrame, targets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(target, feature, rows): features that change where a target is taken away from their source.

    What a feature is computed from shows in what it does, whatever its expression is called: ``make`` runs once more on the source with the
    target null, and rows with equal keys are compared, nulls included; a row that one of the two lacks differs in all features.
    """
    whole = make(source)
    features = [c for c in whole.columns if c not in keys]
    missing = sorted(set(targets) - set(source.columns))
    if missing:
        raise ValueError(f"targets not in the source: {missing}")
    out = None
    for target in targets:
        blind = make(source.withColumn(target, F.lit(None).cast(source.schema[target].dataType)))
        a = whole.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(features)), F.lit(True).alias("_has_a"))
        b = blind.select(*(F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(features)), F.lit(True).alias("_has_b"))
        on = [F.col(f"_k{i}").eqNullSafe(F.col(f"_l{i}")) for i in range(len(keys))]
        lone = F.col("_has_a").isNull() | F.col("_has_b").isNull()
        row = a.join(b, on, "full_outer").agg(*(F.count_if(lone | ~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).alias(f"n{i}") for i in range(len(features))))
        told = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("rows")) for i, c in enumerate(features))))
        part = row.select(F.lit(target).alias("target"), told.alias("x")).select("target", "x.*")
        out = part if out is None else out.unionByName(part)
    return out.where("rows > 0")


def suite(df: DataFrame, checks: Sequence[Check], families: dict[str, Sequence[str]] | None = None, leaks: DataFrame | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """(check, rows, violations, ok) of a feature table; hand in the written one, as each of its columns is read once.

    (``DataFrame.observe`` would count in the pass that writes. A session that has observed can't run models that keep a training summary any
    more: Spark 4.1 ships the summary's session with the model.) Row checks; ``columns``: forbidden names that are there; ``known:family``: cells of a family's columns that are unknown (for information:
    it fails only if a column is unknown everywhere); ``target_leak``: features that depend on a target.
    """
    got = measured(df, checks, families)
    n, out = got["rows"], []
    for name, _ in checks:
        out.append((name, n, got[f"check:{name}"], got[f"check:{name}"] == 0))
    out.append(("columns", len(df.columns), len(set(forbidden) & set(df.columns)), not set(forbidden) & set(df.columns)))
    for family, columns in (families or {}).items():
        known = [got[f"known:{family}:{c}"] for c in columns]
        out.append((f"known:{family}", n, n * len(columns) - sum(known), n == 0 or min(known, default=1) > 0))
    if leaks is not None:
        found = leaks.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        out.append(("target_leak", found["rows"], found["n"], found["n"] == 0))
    return df.sparkSession.createDataFrame(out, "check string, rows long, violations long, ok boolean")
