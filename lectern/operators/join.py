"""Joining texts with tables stored apart, and checking that they fit."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_encoded(corpus: DataFrame, encoded: DataFrame) -> DataFrame:
    """Texts with their encodings, by ``doc_id``."""
    extra = [c for c in encoded.columns if c == "doc_id" or c not in corpus.columns]
    return corpus.join(encoded.select(*extra), "doc_id")


def unmatched(corpus: DataFrame, other: DataFrame) -> DataFrame:
    """``doc_id, missing_in`` of ids present on one side only. Reads the ids alone."""
    left, right = corpus.select("doc_id"), other.select("doc_id")
    return (
        left.withColumn("_left", F.lit(True))
        .join(right.withColumn("_right", F.lit(True)), "doc_id", "full")
        .where(F.col("_left").isNull() | F.col("_right").isNull())
        .select("doc_id", F.when(F.col("_left").isNull(), "corpus").otherwise("other").alias("missing_in"))
    )
