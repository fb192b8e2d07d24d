"""Written intermediate tables and size-checked joins."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of at most this many ids (8 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
# Any other side is broadcast up to this many bytes of values and row heads.
BROADCAST_BYTES = 32 << 20
# What a row of a hash table takes beside its values, about.
ROW_BYTES = 32
# A hash-join build side may hold this many narrow rows per shuffle partition.
HASH_ROWS_PER_PARTITION = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Without that setting, a folder in the warehouse, which they share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that this application has written to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/lectern/{app}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, so a lost executor costs a re-read instead of a recompute,
    and later passes prune columns and count rows from the file footers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``saved`` has written and that is no longer read."""
    files, jvm = df.inputFiles(), df.sparkSession._jvm
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _width(field: T.StructField) -> Column:
    """Bytes of one value: the length of texts, of lists that of their values, else 8."""
    name = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(name)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType)):
        size = F.aggregate(name, F.lit(0), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0)))
    elif isinstance(kind, T.ArrayType):
        size = 8 * F.size(name)
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(8)).cast("bigint")


def table_bytes(df: DataFrame) -> int:
    """Bytes of all rows of a saved table, as a hash table would hold them; one pass."""
    row = sum((_width(field) for field in df.schema), F.lit(ROW_BYTES))
    return df.agg(F.sum(row)).first()[0] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its rows take at most ``limit`` bytes.

    Rows are measured, not counted, as a few of them may hold very long words. Beyond the
    limit the join is left to a shuffle, where adaptive execution splits hot keys. Pass a
    saved table.
    """
    return F.broadcast(df) if table_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out over the cores if the scan's row groups fill fewer tasks.

    A file with one row group is read by one task whatever the split size. Such a table is
    smaller than the cores' worth of row groups, so this shuffle does not grow with the data;
    filters and column choices still reach the scan below it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    # No column is read, only the footers.
    filled = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df.repartition(cores) if 0 < filled < cores else df


def join_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Join wide rows with a saved narrow table of unique ids.

    Few ids: broadcast, and the wide rows do not move. More: the wide rows shuffle
    once by their unique key and probe hash tables. Too many for that: sort-merge.
    """
    n_ids = ids.count()
    if n_ids <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    else:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if n_ids <= HASH_ROWS_PER_PARTITION * partitions:
            ids = ids.hint("shuffle_hash")
    return df.join(ids, key, how)


def most_frequent(counts: DataFrame, size: int, name: str) -> DataFrame:
    """The ``size`` rows of a saved ``token, n, ...`` table with the greatest ``n``.

    Ties go to the lower token. How many tokens have each count tells the least count
    that can be listed, so the final sort sees little more than ``size`` rows instead of
    that many from every task.
    """
    # Distinct counts sum to at most the number of words: a short table.
    frequencies = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    falling = Window.orderBy(F.desc("n"))
    least = (
        frequencies.withColumn("upto", F.sum("m").over(falling))
        .where(F.col("upto") >= size)
        .agg(F.max("n"))
        .first()[0]
    )
    listed = counts if least is None else counts.where(F.col("n") >= least)
    return saved(listed.orderBy(F.desc("n"), "token").limit(size), name)
