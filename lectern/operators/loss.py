"""Class-weighted cross-entropy of logits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scoring import hit
from lectern.operators.labels import class_position, class_side


def with_nll(logits: DataFrame, classes: list | None = None) -> DataFrame:
    """Add ``nll``, the negative log likelihood of the row's own label.

    ``classes`` are the labels in the order of the logits; by default they are 0, 1, ...
    A label that has no logit is an error. The greatest logit is subtracted first, so no
    exponential overflows.
    """
    place = F.col("label") if classes is None else class_position(F.col("label"), classes)
    known = (place >= 0) & (place < F.size("logits"))
    own = F.when(known, F.get("logits", place)).otherwise(
        F.raise_error(F.concat(F.lit("no score for label "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    )
    top = F.array_max("logits")
    total = F.aggregate(
        "logits", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.array_max("logits"))
    )
    return logits.withColumn("nll", top + F.log(total) - own)


def _weighted(batched: DataFrame, weights: DataFrame, classes: list | None) -> DataFrame:
    """Rows with ``nll`` and ``weight``; a label without a weight is an error, not a lost row."""
    joined = with_nll(batched, classes).join(class_side(weights.select("label", "weight")), "label", "left")
    missing = F.raise_error(F.concat(F.lit("no weight for label "), F.col("label").cast("string")))
    return joined.withColumn("weight", F.when(F.col("weight").isNull(), missing).otherwise(F.col("weight")))


def _mean_loss():
    return (F.sum(F.col("weight") * F.col("nll")) / F.sum("weight")).alias("loss")


def weighted_loss(batched: DataFrame, weights: DataFrame, classes: list | None = None) -> DataFrame:
    """``batch_id, n_rows, loss`` from ``batch_id, label, logits``: weighted mean per batch.

    ``weights`` has one row per class.
    """
    return _weighted(batched, weights, classes).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), _mean_loss()
    )


def subset_scalars(batched: DataFrame, weights: DataFrame, classes: list | None = None) -> DataFrame:
    """One row ``n_batches, loss, accuracy``: means of the batches' values, in one pass."""
    per_batch = _weighted(batched, weights, classes).groupBy("batch_id").agg(
        _mean_loss(), F.avg(hit()).alias("accuracy")
    )
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy")
    )


def epoch_loss(batch_losses: DataFrame) -> DataFrame:
    """Plain mean over batches, a short last one included."""
    return batch_losses.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def progress(batch_losses: DataFrame, every: int) -> DataFrame:
    """The losses of every ``every``-th batch, from the first."""
    return batch_losses.where(F.col("batch_id") % every == 0)
