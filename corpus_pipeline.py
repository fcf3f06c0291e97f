"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage reads the table ``docs`` and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder, reads it again, and deletes it once the next
one is written; the last stays. All but the last keep the columns of ``documents``.

What a stage does with nulls, empty and long texts, repeated rows and empty tables is
said at the head of its operator's module; other columns travel along unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, simhash, substring_dedup, toxicity
from tidemark.llm.queries import TOKENIZER, fold
from tidemark.llm.runtime import ensure_checkpoint_dir, remove_folder, ship, table


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("id") != 1)
    return toxicity.drop_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship(spark)
    return simhash.keep_representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; all documents stay."""
    ship(spark)
    return substring_dedup.remove_repeats(docs, chars="n_chars")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, row by row whatever their ids; the rest stays as it is."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text they decode to."""
    ship(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", benchmark_stage),
    ("bpe", token_stage),
]

#: Training, hashing and tokenizing are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
