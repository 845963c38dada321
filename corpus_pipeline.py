"""A training-corpus pipeline of five operators: documents in, token digests out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of ``documents``; their decisions are in the rows and texts they return.

Edge cases: null and empty texts have no letters and go with the first stage; later stages take
them as their operators do; of repeated rows, as of near-duplicates, one row stays; rows of a null
id, or of an id that other texts have too, are documents of their own in every stage; texts of any
length are read whole; of languages that tie the first in the alphabet is taken, of rows that tie
for the smallest id that of the smallest text hash; an empty table gives an empty result; extra
columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import bpe, decontaminate, langid, simhash, suffix
from loamgrid.llm._core import checkpoint, short_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose likeliest language is less likely than this is of no known language.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language; a missing lang is filled in."""
    short_batches(spark)
    held = langid.crc_mod("doc_id", 4) == 2
    model = langid.train(docs.filter(~held))
    found = langid.predict(docs.select(*COLUMNS), model, keep=COLUMNS[2:]).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep one row, with the smallest id; nulls come last."""
    return simhash.survivors(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 100 bytes or more that stands earlier in the corpus; n_chars follows."""
    cut = suffix.dedup(docs, text_out=True, keep=COLUMNS[2:4])
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a whole window of the benchmark, however long they are.

    Items shorter than a window may stand in any text; they count by their share of the words alone.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=("text", *COLUMNS[2:]), whole=True)
    return found.filter(~F.col("contaminated") & ~F.col("whole")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what remains."""
    return bpe.digest(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL has neither the fingerprints' hash nor the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
