"""A training corpus out of raw documents: toxic ones go, near copies and repeats go, test items go, the rest is packed.

Every stage takes any documents: rows with null ids, null, empty and very long texts, repeated rows and ids, further columns
whatever their names, and no rows at all (which give none). What each makes of them is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, jaccard_join, packing, queries, substring_dedup
from plumbline.llm.common import materialize

#: Words whose ids a worker of the packing stage keeps: fewer than packing alone may, as workers live on from stage to stage.
KEPT_WORDS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text the toxicity model (fitted on the labelled documents of sf_dir) predicts as toxic.

    By their own text: of rows with one id only the toxic ones go. Null and empty texts are scored like others. Without labels
    of both kinds nothing is learned and no row goes, unless all labels are toxic.
    """
    return queries.toxicity_model(spark, sf_dir).without_toxic(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of 0.8 and more over five-word shingles: that of the smallest doc_id.

    Texts without words, null ones among them, and rows without an id are copies of nothing and stay. Rows that repeat an id
    are one document: they stay or go together.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages that an earlier document holds.

    Earlier is a smaller doc_id. Rows without an id keep their text. Rows that repeat an id are one document; passages are
    cut from those of its texts that they were found in. Documents that lose all their words go, those that had none stay.
    """
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item of the benchmark of sf_dir.

    By their own text, so null and repeated ids don't matter; null and empty texts hold nothing, and null items match nothing.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens, with their ids. Null and empty texts are an end id each; each row is a document."""
    return packing.pack(docs, queries.word_tokenizer(), end_id=1, kept=KEPT_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: The model, chains and tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
