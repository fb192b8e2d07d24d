"""Records of run parameters and per-epoch values; writing a record again replaces it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAM_SCHEMA = "run_id STRING, name STRING, value STRING"
METRIC_SCHEMA = "run_id STRING, epoch INT, subset STRING, name STRING, value DOUBLE"


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Write, replacing what the same partitions held before."""
    writer = df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def record_params(spark: SparkSession, path: str, run_id: str, params: dict) -> None:
    rows = [(run_id, str(k), str(v)) for k, v in params.items()]
    _replace(spark.createDataFrame(rows, PARAM_SCHEMA), path, "run_id")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAM_SCHEMA).parquet(path).select("run_id", "name", "value")


def record_metrics(values: DataFrame, path: str, run_id: str, epoch: int, subset: str) -> None:
    """Record a one-row frame of scalars, one record per column.

    All values of a run, epoch and subset are recorded together; doing so again replaces
    them.
    """
    entries = [
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in values.columns
    ]
    keys = {"run_id": run_id, "epoch": epoch, "subset": subset}
    rows = values.select(F.inline(F.array(*entries)))
    _replace(rows.withColumns({k: F.lit(v) for k, v in keys.items()}), path, *keys)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.schema(METRIC_SCHEMA).parquet(path)
    return table.select("run_id", "epoch", "subset", "name", "value")
