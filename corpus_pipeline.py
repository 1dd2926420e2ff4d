"""From raw documents to packed training sequences: classify, deduplicate, mix and pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.

Defined cases, for each stage: null and empty texts are documents (what a stage does with them is said there); repeated rows are
treated as the operator says; an empty table gives an empty one; further columns, whatever their names, pass through
all stages but the last.  A stage deletes the intermediate tables of the stage before it over the same folder, whose result has been stored by
then; other queries' tables are left alone.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import mixing, orderminhash, packing, quality, scratch, suffix


@contextlib.contextmanager
def _own_tables(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Intermediate tables belong to the pipeline over ``sf_dir``; those of its earlier stages are deleted."""
    owner = f"pipeline over {sf_dir}"
    scratch.release(spark, owner)
    with scratch.owned(owner):
        yield


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled training rows among ``docs``.  A null or empty text
    gets the score of a text without features, which the labels decide."""
    with _own_tables(spark, sf_dir):
        return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; one of all with a null or empty text."""
    with _own_tables(spark, sf_dir):
        return orderminhash.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that stand earlier in the corpus.  Texts that lose everything go, empty ones stay."""
    with _own_tables(spark, sf_dir):
        left = suffix.remove(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that brings each source to its target; a text without a word has nothing to add and goes."""
    with _own_tables(spark, sf_dir):
        return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 tokens; an empty text is its end token."""
    with _own_tables(spark, sf_dir):
        return packing.pack(docs, capacity=1024, end_token=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("source mix", mixed_sources),
    ("packing", packed),
]

#: Classifier, alignment and packing cannot be stated in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            scratch.delete(spark, f"{folder}/{i - 1}")
    with _own_tables(spark, sf_dir):
        return docs
