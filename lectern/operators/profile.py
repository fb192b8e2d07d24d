"""Tables a person looks at before and after each cleaning step.

Counts and lengths come from text digests and token counts, so no text is shuffled.
Operators that show text fetch it for the rows shown only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import has_tokens
from lectern.operators.clean import (
    MIN_TOKENS,
    copy_groups,
    drop_duplicates,
    drop_empty,
    duplicate_rows,
    is_short,
    with_fingerprint,
    with_n_tokens,
)


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("doc_id").limit(n)


def row_at(df: DataFrame, doc_id: int) -> DataFrame:
    """One record by id; the predicate reaches the scan."""
    return df.where(F.col("doc_id") == doc_id)


def table_summary(df: DataFrame) -> DataFrame:
    """One row per column: name, type, rows, non-null rows. One pass over the table."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_{c}") for c in df.columns]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col(f"_{field.name}").alias("n_non_null"),
        )
        for i, field in enumerate(df.schema)
    ]
    return counted.select("n_rows", F.inline(F.array(*entries)))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("label")


def label_names(df: DataFrame) -> DataFrame:
    return df.select("label").distinct().orderBy("label")


def class_weights(df: DataFrame) -> DataFrame:
    """``label, n_rows, weight`` with weight = 1 - n / N. Give it the training rows."""
    everything = Window.partitionBy()
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "weight", 1 - F.col("n_rows") / F.sum("n_rows").over(everything)
    )


def distinct_texts(df: DataFrame) -> DataFrame:
    """``label, fingerprint, n_tokens, doc_id, n_copies``: each kept row without its text."""
    return copy_groups(with_fingerprint(with_n_tokens(drop_empty(df))), "n_tokens")


def class_profile(df: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Class distribution raw, without copies, and cleaned; most frequent first.

    One pass: copies are counted per distinct text, then summed per label.
    """
    kept = (~is_short(min_tokens)).cast("int")
    everything = Window.partitionBy()
    return (
        distinct_texts(df)
        .groupBy("label")
        .agg(
            F.sum("n_copies").alias("n_raw"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.sum(kept).alias("n_clean"),
        )
        .withColumn("weight", 1 - F.col("n_clean") / F.sum("n_clean").over(everything))
        .orderBy(F.desc("n_raw"), "label")
    )


def length_histogram(df: DataFrame) -> DataFrame:
    """Token counts of the rows kept by de-duplication, most frequent first."""
    return (
        distinct_texts(df)
        .groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), "n_tokens")
    )


def _extreme(df: DataFrame, length: Column) -> DataFrame:
    """The row of least ``length``, then id: the lowest id wins, so no copy can.

    One narrow pass compares lengths and ids; the text is fetched by that id alone, a
    predicate that reaches the scan, and counted again for that one row.
    """
    found = with_n_tokens(drop_empty(df)).agg(F.min(F.struct(length.alias("_length"), "doc_id")).alias("row")).first()["row"]
    one = df.where(F.col("doc_id") == (found.doc_id if found else None))
    return with_n_tokens(drop_empty(one)).select("doc_id", "label", "n_tokens", "text")


def longest_row(df: DataFrame) -> DataFrame:
    """The first row of greatest length."""
    return _extreme(df, -F.col("n_tokens"))


def shortest_row(df: DataFrame) -> DataFrame:
    return _extreme(df, F.col("n_tokens"))


def _between(low: int, high: int) -> Column:
    """``low`` to ``high`` tokens, decided without counting whole texts."""
    return has_tokens("text", low) & ~has_tokens("text", high + 1)


def rows_by_length(df: DataFrame, low: int = 0, high: int = 7, first: int | None = None) -> DataFrame:
    """De-duplicated rows of ``low`` to ``high`` tokens; optionally the first n per length.

    Copies have equal length, so only the rows in range are compared. The per-length
    limit is applied in each map task before any shuffle.
    """
    in_range = drop_empty(df).where(_between(low, high))
    rows = with_n_tokens(drop_duplicates(in_range)).select("n_tokens", "doc_id", "label", "text")
    if first is not None:
        order = Window.partitionBy("n_tokens").orderBy("doc_id")
        rows = (
            rows.withColumn("_nth", F.row_number().over(order))
            .where(F.col("_nth") <= first)
            .drop("_nth")
        )
    return rows


def count_by_length(df: DataFrame, low: int = 0, high: int = 7) -> DataFrame:
    return (
        distinct_texts(drop_empty(df).where(_between(low, high)))
        .groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def top_duplicates(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` copies in text order."""
    return duplicate_rows(df).orderBy("text", "doc_id").limit(n)
