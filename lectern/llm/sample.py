"""Samples of bounded size that do not depend on the layout of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def least_hashes(df: DataFrame, key: str, rows: int, total: int, seed: int = 0) -> DataFrame:
    """The ``rows`` rows of least key hash, of ``total`` rows; all if there are no more.

    A cut on the hash leaves about a fifth more rows than wanted, so that the final sort
    and the driver see about ``rows`` rows, not that many from each task.
    """
    code = F.xxhash64(F.lit(seed), key)
    share = min(1.0, (1.2 * rows + 50) / max(total, 1))
    near = df if share == 1.0 else df.where(F.pmod(code, F.lit(_STEPS)) < int(share * _STEPS))
    return near.orderBy(F.pmod(code, F.lit(_STEPS)), key).limit(rows)
