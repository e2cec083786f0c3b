"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents. ``run`` applies them to the documents table, writing each
stage's rows to the shared folder and reading them back as the next one's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import bpe
from pitspark.llm.common import cut, table
from pitspark.llm.line_dedup import line_dedup
from pitspark.llm.mixing import mix_sources
from pitspark.llm.ngram_jaccard import ngram_jaccard
from pitspark.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Near copies share this part of their word n-grams at least; op1's own query has 3 words and 0.9.
NEAR = {"n": 5, "num": 80, "den": 100}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, each by itself: equal rows share their verdict, null and blank texts go."""
    return quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the boilerplate lines of their source. Null texts stay null; texts of boilerplate only are empty."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word Jaccard of 0.8 or more): that of the smallest id, nulls last.

    Rows that agree in every column count as one, with or without an id; texts without words have no other copies.
    """
    row = F.unhex(F.md5(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})))
    kept = ngram_jaccard(docs, row=row, **NEAR).where("first").select(F.col("row").alias("_kept")).distinct()
    keyed = docs.select(*COLUMNS, row.alias("_row"))
    return keyed.join(kept, keyed["_row"] == kept["_kept"], "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are never taken."""
    taken = mix_sources(docs, keep=COLUMNS).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's token ids and of their decoding; null and empty texts have no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE", encoding),
]

#: SQL can't express the first and last stage; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i + 1}")
    return docs
