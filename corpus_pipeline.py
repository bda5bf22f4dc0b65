"""The corpus pipeline: each stage works on what the last one kept, written as Parquet in the shared folder and read again.

As a stage begins, what it works on has been written, so the scratch tables of the stages before it are dropped.

Defined cases: an empty table gives no rows at every stage; null and empty texts are clean, copies of nothing, hold no personal
data, take no part in the mix, and so are gone after it; rows without a doc_id are never taken for copies; of repeated rows one stays; other
columns are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versoline.llm import jaccard, mixing, packing, pii, toxicity
from versoline.llm.common import Scratch, release, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go. It learns from the labels of documents that are still there."""
    release(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: a row of its least doc_id."""
    release(spark)
    return jaccard.one_of_each(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what identifies a person gives way to its kind."""
    release(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    release(spark)
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in their windows."""
    release(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("n_gram_jaccard_join", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Training a field, links between sets and a tokenizer aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            scratch = Scratch(spark)
            docs = scratch.stored(docs, name)
            if last is not None:
                last.drop()
            last = scratch
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
