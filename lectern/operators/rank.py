"""Dense row numbers, batches and epoch shuffles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.hashing import seeded_hash
from lectern.plans.shared import saved

# monotonically_increasing_id keeps the row within its partition in the low 33 bits.
_ROW_BITS = 33


def row_numbers(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Add the dense 0-based position in ``order``, which must be a total order.

    Rows are range-partitioned (sampled bounds, so equal parts whatever the key
    values), sorted and written once; a row's number is its index within its part
    plus the sizes of the parts before it. No window runs over the rows. Pass narrow
    rows.
    """
    slotted = saved(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "row-numbers",
    )
    part = F.shiftright("_slot", _ROW_BITS).alias("_part")
    # One row per written part, at most spark.sql.shuffle.partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slotted.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        slotted.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + within).alias(name))
    )


def batches(df: DataFrame, size: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """Add ``position`` and ``batch_id``: in ``doc_id`` order, or shuffled by seed and epoch."""
    order = ["doc_id"] if seed is None else [seeded_hash("doc_id", seed, epoch), "doc_id"]
    return row_numbers(df, *order).withColumn(
        "batch_id", F.floor(F.col("position") / size)
    )


def batch_totals(df: DataFrame, size: int, epochs: int) -> DataFrame:
    """Rows, batches (a short last one counts) and steps per split."""
    n_batches = F.ceil(F.count(F.lit(1)) / size)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        n_batches.alias("n_batches"),
        (n_batches * epochs).alias("n_steps"),
    )
