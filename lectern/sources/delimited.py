"""Delimited text whose quoted fields hold line breaks, each file read by many tasks.

Whether a block of a file begins inside a quoted field depends on all quotes before it. Each
task counts the quotes of its block for both cases; running over the blocks, a table of one
row each, tells which case holds, and with it where records begin and what number they have.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.shared import saved, small_side

_LINES = (
    "file string, block bigint, line bigint, inside boolean, odd boolean, blank boolean, "
    "starts_out bigint, starts_in bigint, value string"
)


def _number_lines(quote: str):
    """For each line: its number in its block, whether it begins inside a field if the block
    begins outside one, whether its quotes are odd, and the records begun so far in the block
    if that begins outside a field or inside one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        before = np.zeros(4, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file"), batch.column("block").to_numpy()
            names = files.dictionary_encode()
            codes = names.indices.to_numpy()
            value = batch.column("value")
            odd = pc.count_substring(value, quote).to_numpy(zero_copy_only=False) % 2
            blank = pc.is_in(value, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            opens = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
            columns = [[], [], [], []]
            for low, high in zip(opens, [*opens[1:], len(codes)]):
                key = (names.dictionary[int(codes[low])].as_py(), int(blocks[low]))
                if key != held[0]:
                    held, before = (key, None), np.zeros(4, np.int64)
                line, parity, out, into = before
                upto = parity + np.cumsum(odd[low:high])
                inside = np.r_[parity, upto[:-1]] % 2
                begins_out = out + np.cumsum((inside == 0) & ~blank[low:high])
                begins_in = into + np.cumsum((inside == 1) & ~blank[low:high])
                for column, values in zip(columns, (line + np.arange(high - low), inside == 1, begins_out, begins_in)):
                    column.append(values)
                before = np.array([line + high - low, upto[-1], begins_out[-1], begins_in[-1]])
            line, inside, begins_out, begins_in = (pa.array(np.concatenate(c)) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [files, batch.column("block"), line, inside, pa.array(odd == 1), pa.array(blank), begins_out, begins_in, value],
                names=["file", "block", "line", "inside", "odd", "blank", "starts_out", "starts_in", "value"],
            )

    return run


def read_quoted(
    spark: SparkSession, path: str, schema: str, sep: str = "\t", quote: str = '"', name: str = "doc_id"
) -> DataFrame:
    """The records of headerless delimited text and ``name``, their 0-based place in the file(s).

    Quotes enclose whole fields and are doubled inside them, as ``write_text_corpus`` writes
    them; a field in quotes may hold separators and line breaks. Lines end with a line feed,
    records also with a carriage return before it; empty lines between records are skipped.
    Files follow each other by their part number, then name. A file's blocks are read by as
    many tasks; its lines are written once, and only records of several lines are shuffled.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = saved(lines.mapInArrow(_number_lines(quote), _LINES), "lines")
    # One row for each block of a file.
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    earlier = Window.orderBy(part, "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(
        F.sum(F.col("odd").cast("bigint")).alias("quotes"), F.max("starts_out").alias("out"), F.max("starts_in").alias("into")
    )
    zero = F.lit(0).cast("bigint")
    blocks = blocks.withColumn("flip", F.coalesce(F.sum("quotes").over(in_file), zero) % 2 == 1)
    starts = F.when(F.col("flip"), F.col("into")).otherwise(F.col("out"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum(starts).over(earlier), zero)).select("file", "block", "flip", "base")
    placed = lines.join(small_side(saved(blocks, "blocks")), ["file", "block"])
    inside = F.col("inside") != F.col("flip")
    begun = F.when(F.col("flip"), F.col("starts_in")).otherwise(F.col("starts_out"))
    placed = placed.where(inside | ~F.col("blank")).select(
        (F.col("base") + begun - 1).alias("record"), "block", "line", "value", (~inside & ~F.col("odd")).alias("whole")
    )
    pieces = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = placed.where("NOT whole").groupBy("record").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
    records = placed.where("whole").select("record", "value").unionByName(joined)
    fields = F.from_csv(F.regexp_replace("value", "\r$", ""), schema, {"sep": sep, "quote": quote, "escape": quote})
    return records.select("record", fields.alias("fields")).select("fields.*", F.col("record").alias(name))
