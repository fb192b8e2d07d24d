"""Corpus, encoding and vocabulary files.

Between steps tables are Parquet. The text and JSON forms are for exchange: they have
no ids, so rows are numbered by their place in the file(s).
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.shared import saved, small_side

CORPUS_SCHEMA = "label INT, text STRING"
# Parts of a table that one task writes at a time; of more, it sorts the rows that are left.
OPEN_PARTS = 4
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite, so a rerun leaves the same rows.

    Tasks that write few parts keep a file of each open instead of sorting their rows first.
    """
    writer = df.write.mode("overwrite")
    if not partition_by:
        writer.parquet(path)
        return
    conf = df.sparkSession.conf
    before = conf.get(_OPEN_FILES, None)
    conf.set(_OPEN_FILES, str(OPEN_PARTS))
    try:
        writer.partitionBy(partition_by).parquet(path)
    finally:
        conf.unset(_OPEN_FILES) if before is None else conf.set(_OPEN_FILES, before)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One part of a table written with ``partition_by="split"``; reads that folder alone."""
    return spark.read.parquet(path).where(F.col("split") == split)


def _file_order() -> list[Column]:
    """Place of a row: file, start of the block read, order within the block."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def read_text_corpus(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    schema: str = CORPUS_SCHEMA,
    quoted_newlines: bool = True,
) -> DataFrame:
    """Headerless delimited text with doubled quotes. No ids; see ``number_rows``.

    A quoted text may hold line breaks, which keeps a file in one task: give many
    files, or set ``quoted_newlines=False`` for one-line records so that large files
    are cut into blocks.
    """
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", quoted_newlines)
        .csv(path)
    )


def number_rows(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Add the 0-based place of each row of a file-backed DataFrame in its file(s).

    The rows are written once and not shuffled: a row's number is its index in the
    block it was read from plus the sizes of the blocks before it.
    """
    placed = saved(df.select("*", *_file_order()), "placed-rows")
    # Part files by their number: names alone would sort part-100000 before part-99999.
    part = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    before = Window.orderBy(part, "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file block, so the running sum is over a small table.
    blocks = (
        placed.groupBy("_file", "_block")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    place = F.col("_start") + F.col("_row") - F.col("_first")
    return placed.join(small_side(saved(blocks, "blocks")), ["_file", "_block"]).select(
        *df.columns, place.alias(name)
    )


def write_text_corpus(df: DataFrame, path: str, sep: str = "\t", order: str = "doc_id") -> None:
    """``label, text`` without a header, in ``order``; outer blanks are kept."""
    (
        df.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select("label", "text")
        .write.mode("overwrite")
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json_arrays(df: DataFrame, column: str, path: str, order: str = "doc_id") -> None:
    """One JSON array per line, in ``order``."""
    (
        df.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select(F.to_json(column).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def read_json_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``position, <name> ARRAY<INT>`` from a JSON array of integer arrays.

    Records end at ``]`` instead of at a line break, so a single huge array is cut
    into blocks like any text file; one array per line reads the same way. Empty arrays
    are records too; one that holds anything but integers is null.
    """
    records = spark.read.option("lineSep", "]").text(path)
    inner = F.concat(F.lit("["), F.substring_index("value", "[", -1), F.lit("]"))
    numbers = F.from_json(inner, "array<int>")
    rows = records.where(F.col("value").contains("[")).select("_metadata", numbers.alias(name))
    return number_rows(rows, "position").select("position", name)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``token, id`` from a text file with one token per line; the id is the line number."""
    rows = number_rows(spark.read.text(path), "id")
    return rows.select(F.col("value").alias("token"), F.col("id").cast("int").alias("id"))
