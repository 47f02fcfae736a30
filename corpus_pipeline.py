"""The corpus pipeline: STAGES in order, each on all that its predecessor kept.

All stages but the last return the columns of documents; the last returns pieces with their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barflow.llm.common import ship, table, written
from barflow.llm.decontamination import keep_clean
from barflow.llm.ngram_join import one_of_each
from barflow.llm.packing import packing
from barflow.llm.quality_rules import keep_good
from barflow.llm.queries import TOKENIZER
from barflow.llm.suffix_dedup import without_repeats

#: The near-duplicate stage: words of a shingle, similarity.
WORDS, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    ship(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    ship(spark)
    return one_of_each(docs, words=WORDS, num=NUM, den=DEN)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand at two places are taken out of the texts; every row stays."""
    ship(spark)
    return without_repeats(docs, chars_col="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    ship(spark)
    return packing(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", sequences),
]

#: Suffix arrays and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
