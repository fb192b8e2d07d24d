"""Seeded orders that any engine can recompute."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key, *seeds) -> Column:
    """md5 of ``seed:...:key`` as lower-case hex."""
    return F.md5(F.concat_ws(":", *[F.lit(str(s)) for s in seeds], F.col(key).cast("string")))


def unit_hash(key, *seeds) -> Column:
    """The leading 32 bits of the seeded hash as a number in [0, 1)."""
    head = F.conv(F.substring(seeded_hash(key, *seeds), 1, 8), 16, 10)
    return head.cast("double") / F.lit(float(2**32))
