"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but
the last return the columns of documents; `n_chars` follows the text.

Defined cases, in every stage: rows are decided one by one, so repeated rows, several texts of an id and rows without an id are
each answered; null, empty and blank texts stay through every stage (packing gives them their end id alone); an empty table gives
no rows; texts of any length are read whole; columns beyond those of documents are carried, whatever their names.
Ties go to the smallest id, as each operator says. Without labels of both kinds no document is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icspark.llm import decontam, lines, minhash, packing, toxicity
from icspark.llm.common import Scratch, free_name, table

#: The stage joins documents from 0.8 on; op7 by itself, as its SQL, from 0.85.
NEAR_PERCENT = 80


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars agrees with the text again."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


BLANK = "text is null or trim(text) = ''"


def _unless_emptied(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage without the documents that it emptied; those null or blank before stay."""
    before = free_name(docs, "blank_before")
    return stage(docs.withColumn(before, F.expr(BLANK))).where(F.col(before) | ~F.expr(BLANK)).drop(before)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labelled rows among docs. Null and blank texts score as clean."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut but where they stand first; a document of which nothing is left goes, one blank before stays.

    Equal rows share one decision; rows without an id keep all their lines.
    """
    return _unless_emptied(docs, lambda d: _measured(lines.dedup(d)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of word-shingle similarity NEAR_PERCENT or more stays, that of the smallest id, with all its rows that belong to the group."""
    return minhash.keep_one(docs, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark, or of which nothing is left, goes, one blank before stays."""
    return _unless_emptied(docs, lambda d: _measured(decontam.remove(d, table(spark, sf_dir, "benchmark"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]
#: A trained model and a tokenizer's vocabulary can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.cut(docs)
    return docs
