"""Accuracy, precision, recall and F1 per label, batched and global, and error tables.

Two definitions that differ in their numbers: ``batch_mean_metrics`` rounds each
batch's values to two decimals and averages the batches; ``global_metrics`` counts
all rows at once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import argmax
from lectern.functions.scoring import hit, precision_recall_f1
from lectern.plans.shared import join_ids, saved

METRIC_DIGITS = 2


def with_prediction(logits: DataFrame, classes: list | None = None) -> DataFrame:
    """Add ``prediction``, the label of greatest score; the first one wins a tie.

    ``classes`` are the labels in the order of the logits; by default they are 0, 1, ...
    """
    place = argmax("logits")
    label = place if classes is None else F.get(F.array(*[F.lit(c) for c in classes]), place)
    return logits.withColumn("prediction", label)


def predict(logits: DataFrame, classes: list | None = None) -> DataFrame:
    """Replace ``logits`` by ``prediction``; see ``with_prediction``."""
    return with_prediction(logits, classes).drop("logits")


def _tally(label: Column, tp, predicted, actual) -> Column:
    return F.struct(
        label.cast("int").alias("label"),
        F.lit(tp).cast("bigint").alias("tp"),
        F.lit(predicted).cast("bigint").alias("predicted"),
        F.lit(actual).cast("bigint").alias("actual"),
    )


def _row_tallies() -> list[Column]:
    """What one row adds: to its own label, and to the label predicted for it."""
    return [
        _tally(F.col("label"), hit(), 0, 1),
        _tally(F.col("prediction"), 0, 1, 0),
    ]


def _sum_tallies(tallies: DataFrame, *keys: str) -> DataFrame:
    return tallies.groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"),
        F.sum("actual").alias("actual"),
    )


def batch_metrics(batched: DataFrame, labels: list[int], size: int) -> DataFrame:
    """``batch_id, label, tp, predicted, actual, precision, recall, f1`` for every label.

    ``batched`` holds ``position, batch_id, label, prediction``. The first row of a
    batch also adds a zero for every label, so labels absent from the batch appear
    with 0 and no batch x label product is needed.
    """
    zeros = F.when(
        F.col("position") % size == 0, F.transform(F.lit(labels), lambda c: _tally(c, 0, 0, 0))
    ).otherwise(F.array().cast("array<struct<label:int,tp:bigint,predicted:bigint,actual:bigint>>"))
    tallies = batched.select("batch_id", F.inline(F.concat(F.array(*_row_tallies()), zeros)))
    return _sum_tallies(tallies, "batch_id").select(
        "batch_id",
        "label",
        "tp",
        "predicted",
        "actual",
        *[F.round(v, METRIC_DIGITS).alias(k) for k, v in precision_recall_f1().items()],
    )


def batch_accuracy(batched: DataFrame) -> DataFrame:
    """``batch_id, n_rows, accuracy``, not rounded."""
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(hit()).alias("accuracy")
    )


def batch_mean_metrics(per_batch: DataFrame) -> DataFrame:
    """Mean of the rounded batch values per label; every batch weighs the same."""
    return per_batch.groupBy("label").agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )


def mean_accuracy(per_batch: DataFrame) -> DataFrame:
    return per_batch.agg(
        F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n_batches")
    )


def results_table(batched: DataFrame, labels: list[int], size: int) -> DataFrame:
    """Batch means in label order."""
    return batch_mean_metrics(batch_metrics(batched, labels, size)).orderBy("label")


def global_metrics(predictions: DataFrame, labels: list[int]) -> DataFrame:
    """Unbatched, unrounded values per label; labels never seen score 0."""
    tallies = predictions.select(F.inline(F.array(*_row_tallies())))
    zeros = predictions.sparkSession.createDataFrame([(c, 0, 0, 0) for c in labels], tallies.schema)
    return _sum_tallies(tallies.unionByName(zeros)).select(
        "label", "tp", "predicted", "actual",
        *[v.alias(k) for k, v in precision_recall_f1().items()],
    )


def with_predictions(corpus: DataFrame, predictions: DataFrame) -> DataFrame:
    """``doc_id, label, prediction, text``: predictions joined to their rows by id."""
    return corpus.join(predictions.select("doc_id", "prediction"), "doc_id").select(
        "doc_id", "label", "prediction", "text"
    )


def errors(corpus: DataFrame, predictions: DataFrame, first: int | None = None) -> DataFrame:
    """Rows whose label and prediction differ; optionally the first n in id order.

    The wrong ids are found among the narrow predictions; texts are fetched for them alone.
    """
    wrong = predictions.where(F.col("label") != F.col("prediction")).select("doc_id", "prediction")
    if first is not None:
        wrong = wrong.orderBy("doc_id").limit(first)
    found = join_ids(corpus, saved(wrong, "errors"), "inner")
    return found.select("doc_id", "label", "prediction", "text")
