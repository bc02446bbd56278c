"""What the two classifiers share: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder

#: Labelled documents that a model is fitted on, at most: those with the least hash of doc_id.
SAMPLE = 8_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, y of at most size labelled documents for which learn holds. Labels that are null or neither 0 nor
    1 don't count; of labels that share a doc_id one is taken. The chosen ids (at most size) are broadcast, so that no
    text is shuffled."""
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn)
    found = found.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return documents(docs).join(F.broadcast(found), "doc_id")


def held_out(parts: int, part: int) -> Column:
    return remainder(F.col("doc_id"), parts) == part
