"""Five stages over the documents table; each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, language_id, minhash, packing, suffix_dedup
from ledgerloom.llm.common import collect_garbage, delete, scratch, scratch_path, table


def settled(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, begun with what the stages before it left in the executors' heaps cleared away."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return begun


@settled
def accept_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language no evidence makes likely go."""
    return language_id.drop_rejected(docs, pages=table(spark, sf_dir, "pages"))


@settled
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


@settled
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_copies(docs, percent=80)


@settled
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has are cut out."""
    return suffix_dedup.drop_repeats(docs)


@settled
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, in which all sources that are left have equal shares."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), targets=packing.EQUAL).drop("ids")


STAGES = [
    ("language_id", accept_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]
#: SQL cannot express the language model, the signatures and the tokenizer; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``. What a stage and the one before it wrote goes once the stage's
    rows are written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = path, scratch_path(spark, name)
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        if before:
            delete(spark, before)
        docs = spark.read.schema(rows.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
