"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, line_dedup, mix, packing
from tessera.llm.common import materialize, table

#: A document stays if one language has at least this proportion of it.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in which no language has a majority."""
    model = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model, keep=True)
    return found.filter((found["lang_pred"] != "und") & (found["score"] >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's boilerplate lines out; every document stays."""
    clean = line_dedup.drop_boilerplate(docs, ratio=0.05, min_pages=3)
    return clean.selectExpr(*[f"CAST(length(text) AS BIGINT) AS {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard_join.keep_first(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents until each source nearly meets its target; the order is the training order."""
    return mix.mixed_documents(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, in the order in which the stage before wrote them."""
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    cols = [F.col("doc_id"), F.col("text"), part.alias("part"), F.col("_metadata.row_index").alias("place")]
    return packing.pack(docs.select(*cols), order=("part", "place"))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mixing), ("packing", pack)]

#: Language identification and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
