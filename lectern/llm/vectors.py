"""Sums of long count vectors over all tasks, without meeting in one of them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.shared import saved

# Vectors of a key that one task adds up, about.
FAN_IN = 64


def add_up(vectors: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Sum of the ``vector`` (binary, 64-bit numbers) of each ``key`` string.

    Input rows are ``key, part, vector``, one for each key and task (``part`` is the task).
    Each round adds about ``fan_in`` neighbouring parts of a key, and is written, until one
    is left; so no task reads more than that of a key, however many tasks there were. A
    task holds one vector for each key it meets.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        least: dict[str, int] = {}
        for batch in batches:
            for key, part, raw in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), batch.column("vector")):
                found = np.frombuffer(raw.as_py(), np.float64)
                sums[key] = sums[key] + found if key in sums else found.copy()
                least[key] = min(least.get(key, part), part)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([least[k] for k in keys], pa.int64()), pa.array([sums[k].tobytes() for k in keys], pa.binary())],
            names=["key", "part", "vector"],
        )

    schema = "key string, part bigint, vector binary"
    # Parts of one group have the group's number, so that equal ones meet in one task.
    last = 1
    while last:
        grouped = vectors.select("key", F.floor(F.col("part") / fan_in).alias("part"), "vector")
        vectors = saved(grouped.repartition("key", "part").mapInArrow(total, schema), "sums")
        last = vectors.agg(F.max("part")).first()[0]
    return vectors.select("key", "vector")
