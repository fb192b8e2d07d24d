"""Class tables: the values of a label column and their dense indices."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.shared import small_side


def class_values(df: DataFrame, column: str) -> list:
    """The sorted distinct values of a class column. Reads that column alone."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(row[0] for row in found)


def class_table(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """``column, name``: each distinct value and its 0-based place in their order.

    The window runs over the distinct values, which the aggregate has brought together.
    """
    order = Window.orderBy(column)
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.withColumn(name, (F.row_number().over(order) - 1).cast("int"))


def class_side(df: DataFrame) -> DataFrame:
    """Mark a one-row-per-class table for broadcast if it is small enough; see ``small_side``."""
    return small_side(df)


def with_class(df: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """Add the columns of a class table; null where the value is not one of them."""
    return df.join(class_side(classes), column, "left")


def class_position(label: Column, values: list) -> Column:
    """0-based place of a label among the classes in order; null if it is not one of them."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), label) - 1
    return F.when(position >= 0, position).cast("int")
