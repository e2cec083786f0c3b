"""Line dedup by site-relative frequency.

For each site, the share of its pages that hold a line; lines above ``ratio`` of
the site's pages are boilerplate and leave every page of that site. Lines are told
apart by 64-bit hashes, lines without a word stay, a line counts once for a page.
A site is any column: the host of a url (``url_filter.host_of``), or a source.

The pages of a site hold ``lines`` distinct lines on average, so at most
``lines / ratio`` lines of it are boilerplate: a site's list is bounded and joins to
its pages as one row, broadcast if all lists together are small, else by a shuffle.

A row is a page, whatever its id: equal rows count each. A null text stays null, a null
site is a site of its own, a page of boilerplate only keeps an empty text. Line ends are
newlines; lines must agree in every character. An empty table gives an empty result; columns
of any other name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small

#: Between the lines that repeat by chance (24 of 500 pages of a source of sf0.1 at most) and boilerplate (43 of 500 at least).
RATIO, LEAST_PAGES = 0.06, 5
#: All sites' lists may be broadcast up to so many hashes of 8 bytes, and tables of sites up to so many rows.
HASHES, SITES = 1 << 21, 10_000


def _blank(line: Column) -> Column:
    return ~line.rlike(WORD)


def _site(site: str | Column) -> Column:
    return F.col(site) if isinstance(site, str) else site


def boilerplate(docs: DataFrame, site_col: str | Column = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(site, lines): the hashes of each site's boilerplate lines; sites without any are left out."""
    pages = docs.select(_site(site_col).alias("site"), F.col(text_col).alias("text"))
    lines = pages.select("site", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(~_blank(F.col("line")))
    counts = lines.groupBy("site", F.xxhash64("line").alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = cut(counts, "lines")
    totals = small(cut(pages.groupBy("site").agg(F.count("*").alias("pages")), "sites"), SITES).withColumnRenamed("site", "s")
    often = counts.join(totals, F.col("site").eqNullSafe(F.col("s"))).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def line_dedup(docs: DataFrame, site_col: str | Column = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """docs with the text without boilerplate lines, and n_lines and n_dropped."""
    marked = cut(boilerplate(docs, site_col, text_col, ratio, least), "boilerplate")
    size = marked.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    if size[0] <= SITES and size[1] <= HASHES:
        marked = F.broadcast(marked)
    rows = docs.select(F.struct("*").alias("row"), _site(site_col).alias("at"), F.split(F.col(text_col), "\n").alias("split"))
    rows = rows.join(marked, F.col("at").eqNullSafe(F.col("site")), "left")
    left = F.filter("split", lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(x)) | _blank(x))
    rows = rows.withColumn("left", F.when(F.col("lines").isNull(), F.col("split")).otherwise(left))
    n, dropped = F.coalesce(F.size("split"), F.lit(0)), F.coalesce(F.size("split") - F.size("left"), F.lit(0))
    none = F.col("split").isNull()
    own = [F.array_join("left", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*own, F.when(none, 0).otherwise(n).cast("long").alias("n_lines"), F.when(none, 0).otherwise(dropped).cast("long").alias("n_dropped"))
