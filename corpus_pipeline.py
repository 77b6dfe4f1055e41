"""The corpus pipeline: language ID, quality, exact dedup, near dedup, packing.

Each stage reads what its predecessor wrote as Parquet. All but the last return the columns of documents, whatever
further columns the table has and whatever their names. Nulls: a null text has no letters, so language ID drops it;
a null lang or label teaches nothing; rows without an id are in no near-duplicate class and stay there. Empty texts
go like null ones; very long texts are read whole. Of repeated rows one stays. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import exact_dedup, lang_id, near_dup, packing, quality
from corpusq.functions.lineage import delete_folder, shared_folder
from corpusq.llm.common import read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the language models reject: texts without letters or unlike every learned language."""
    return lang_id.keep_accepted(docs, lang_id.fit(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted to be of low quality: a score under 0.3. Without labels all stay."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that of the largest id (rows that repeat it: one of them)."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the smallest id. Rows without an id stay too."""
    classes = near_dup.near_classes(docs, least=0.8)
    kept = docs.join(classes.where("kept and doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("quality", quality_filter), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("packing", pack_windows)]

#: Trained models and packing cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again.

    What the stage after has read is deleted; the last folder stays, as the result is computed from it when it is used.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
