"""Exact stratified splits and an approximate one."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.hashing import seeded_hash, unit_hash
from lectern.operators.labels import class_side
from lectern.plans.shared import saved

# Leading hex digits of the seeded hash that form a bucket: 65,536 buckets a label.
_BUCKET_DIGITS = 4


def allocate(sizes: dict[int, int], fraction: float) -> dict[int, int]:
    """Rows to keep per class after setting ``fraction`` aside, by largest remainder.

    The set-aside part has ``ceil(fraction * N)`` rows; each class keeps its whole share
    of the others and the largest remainders (lower label first) one more.
    """
    if min(sizes.values(), default=0) < 2:
        raise ValueError("every class needs at least 2 rows to be split")
    total = sum(sizes.values())
    kept = total - math.ceil(fraction * total)
    shares = {label: float(n) * kept / total for label, n in sizes.items()}
    quotas = {label: math.floor(share) for label, share in shares.items()}
    by_remainder = sorted(shares, key=lambda label: (quotas[label] - shares[label], label))
    for label in by_remainder[: kept - sum(quotas.values())]:
        quotas[label] += 1
    return quotas


def quotas(sizes: DataFrame, fraction: float) -> DataFrame:
    """``label, quota`` from ``label, n``: what ``allocate`` gives, for any number of classes.

    The windows run over one row a class. Three numbers reach the driver.
    """
    whole = sizes.agg(
        F.sum("n").alias("total"), F.min("n").alias("least"), F.sum(F.when(F.col("label").isNull(), F.col("n"))).alias("bare")
    ).first()
    if whole.bare:
        raise ValueError(f"{whole.bare} rows have no label and cannot be split by class")
    if (whole.least or 0) < 2:
        raise ValueError("every class needs at least 2 rows to be split")
    kept = whole.total - math.ceil(fraction * whole.total)
    share = F.col("n").cast("double") * F.lit(kept) / F.lit(whole.total)
    by_remainder = Window.orderBy(F.col("quota") - F.col("share"), "label")
    spare = F.lit(kept) - F.sum("quota").over(Window.partitionBy())
    one_more = (F.row_number().over(by_remainder) <= spare).cast("bigint")
    floors = sizes.withColumn("share", share).withColumn("quota", F.floor("share"))
    return floors.select("label", (F.col("quota") + one_more).alias("quota"))


def _cut_points(keys: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Per class the greatest (hash, id) that is still kept: a written table, a row a class.

    Keeping the k lowest hashes of a class needs the k-th lowest, not a rank for every
    row: bucket counts find the bucket holding it, and only the rows of that one bucket
    are ordered. No class reaches the driver.
    """
    keys = keys.withColumn("hash", seeded_hash("doc_id", seed)).withColumn(
        "bucket", F.substring("hash", 1, _BUCKET_DIGITS)
    )
    counts = saved(keys.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n_bucket")), "bucket-counts")
    quota_of = saved(quotas(counts.groupBy("label").agg(F.sum("n_bucket").alias("n")), fraction), "quotas")
    running = Window.partitionBy("label").orderBy("bucket")
    upto, quota = F.col("upto"), F.col("quota")
    edge = saved(
        counts.withColumn("upto", F.sum("n_bucket").over(running))
        .join(class_side(quota_of), "label")
        .where((quota <= upto) & (quota > upto - F.col("n_bucket")))
        .select("label", "bucket", (quota - upto + F.col("n_bucket")).alias("nth")),
        "edges",
    )
    in_bucket = Window.partitionBy("label").orderBy("hash", "doc_id")
    cuts = (
        keys.join(class_side(edge), ["label", "bucket"])
        .withColumn("rank", F.row_number().over(in_bucket))
        .where(F.col("rank") == F.col("nth"))
        .select("label", "hash", "doc_id")
    )
    # A class that keeps nothing has no cut: every hash lies beyond the empty string.
    found = quota_of.join(cuts, "label", "left").select(
        "label", F.coalesce("hash", F.lit("")).alias("cut_hash"), F.coalesce("doc_id", F.lit(0)).alias("cut_id")
    )
    return saved(found, "cuts")


def _beyond(df: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Add ``_beyond``: does the row lie after its class's cut in hash order?"""
    here = F.struct(seeded_hash("doc_id", seed), F.col("doc_id"))
    cut = F.struct(F.col("cut_hash"), F.col("cut_id"))
    return (
        df.join(class_side(cuts), "label")
        .withColumn("_beyond", here > cut)
        .drop("cut_hash", "cut_id")
    )


def stratified_split(
    df: DataFrame,
    parts: Sequence[tuple[str, float, int]] = (("test", 0.2, 42), ("valid", 0.2, 43)),
    rest: str = "train",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: cut each part's fraction off what the earlier parts left.

    ``parts`` is (name, fraction, seed). Sizes per class are exact, membership depends
    on ``doc_id`` and seed alone. The key columns are read a few times: pass a saved
    table, or a saved ``doc_id, label`` of the same rows as ``keys``. The other columns
    are read once, by whoever uses the result.
    """
    split: Column = F.lit(rest)
    left = (df if keys is None else keys).select("doc_id", "label")
    marked, flags = df, []
    for index, (name, fraction, seed) in enumerate(parts):
        cuts = _cut_points(left, fraction, seed)
        left = _beyond(left, cuts, seed).where(~F.col("_beyond")).drop("_beyond")
        flag = f"_beyond_{index}"
        marked = _beyond(marked, cuts, seed).withColumnRenamed("_beyond", flag)
        flags.append((flag, name))
    for flag, name in reversed(flags):
        split = F.when(F.col(flag), F.lit(name)).otherwise(split)
    return marked.select(*df.columns, split.alias("split"))


def approximate_split(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` by hash alone: one pass, no counts, sizes near the fraction."""
    chosen = unit_hash("doc_id", seed) < F.lit(fraction)
    return df.withColumn("split", F.when(chosen, "test").otherwise("train"))
