"""A bounded sample of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are used to fit a classifier.
LABEL_SAMPLE = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, limit: int = LABEL_SAMPLE) -> DataFrame:
    """(text, y, labelled_id) of at most `limit` labelled documents that `in_training` accepts.

    Labels of a document are averaged and rounded; null ids, labels and texts are left out. The
    sample is the ids of least hash, so it doesn't depend on the order of rows; its size is
    bounded, hence the broadcast. Of rows that repeat an id the text of least hash counts, so there
    is one row an id.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & in_training)
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").alias("labelled_id"), "text").filter("text is not null")
    met = texts.join(F.broadcast(chosen), "labelled_id")
    return met.groupBy("labelled_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y", "labelled_id")
