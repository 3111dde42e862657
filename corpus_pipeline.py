"""A corpus from raw documents to training sequences, in stages.

Each stage reads what its predecessor wrote; all but the last return the columns of ``documents``. Weak-supervision
quality, consistent weighted sampling and a tokenizer are beyond SQL, so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, mixing, near_dup, packing, quality_rules, scratch
from tessera.llm.queries import tokenizer
from tessera.llm.text import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows leave the texts; n_chars follows."""
    return line_dedup.cut_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix of sources takes them: a row for each time. Packing needs no order of slots."""
    return mixing.mix(docs, ordered=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
