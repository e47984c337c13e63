"""From documents to packed training sequences: five stages over whole tables.

Each stage takes what the one before it kept and returns a DataFrame; run() writes each
result as Parquet to the shared folder and reads it back, so a lost executor costs one
stage at most.  All stages but the last return the columns of documents.

Defined results: null and empty texts pass the first two stages if an empty text is not
rejected, link with nothing in the third, and have no words for the fourth, which takes none of
them; rows without an id are scored, cleaned, kept and mixed like others; rows that repeat an
id are one document where documents are counted; of equal texts the smallest id stays; empty
tables give empty results; further columns are carried to the last stage, which has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common, jaccard, lines, mixing, packing, toxicity
from inkstone.plans.staging import stage


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, n_chars brought up to date with the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return docs.select(*columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labelled ones, rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay."""
    return _measured(lines.drop_common_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, 80 %) the smallest id stays."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each pass that their source's target asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as best fit finds."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first, third and fifth stage have no SQL form; tests/llm check their operators against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
