"""From raw documents to training tokens: language ID, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
A stage's result is written as Parquet and read again as the next one's docs, and removed when that one is written, the
last when the session's process ends. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkforge.llm import bpe, language, mixing, simhash
from linkforge.llm.common import remove_folder, scratch_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on their labels, doesn't reject."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (0.8 on five words): that of the least doc_id."""
    return simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, range-sorted by training position."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids of each row; where docs are files, the row's place.

    The mixing stage's parts and rows are in training order: input_part (a file's name) and input_row keep it in the output.
    """
    return bpe.encode_documents(docs, with_ids=True, with_place=bool(docs.inputFiles()))


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode)]

#: Training, near-duplicates and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = scratch_folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
