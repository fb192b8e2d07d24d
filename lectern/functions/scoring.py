"""Metric arithmetic shared by the batched and the global reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keeps every ratio finite, so an absent label scores 0.
EPSILON = 1e-7


def ratio(part, whole) -> Column:
    return F.col(part) / (F.col(whole) + F.lit(EPSILON))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * (precision * recall) / (precision + recall + F.lit(EPSILON))


def precision_recall_f1(tp="tp", predicted="predicted", actual="actual") -> dict[str, Column]:
    precision, recall = ratio(tp, predicted), ratio(tp, actual)
    return {"precision": precision, "recall": recall, "f1": f1(precision, recall)}


def hit(label="label", prediction="prediction") -> Column:
    return (F.col(label) == F.col(prediction)).cast("int")
