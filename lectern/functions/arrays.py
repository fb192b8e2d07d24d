"""Column expressions over id arrays and class-score arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_ids(ids: Column, max_len: int, start: int, end: int) -> Column:
    """Cut to ``max_len - 2`` ids and put the start and end markers around them."""
    return F.concat(
        F.array(F.lit(start)), F.slice(ids, 1, max_len - 2), F.array(F.lit(end))
    )


def pad_right(ids: Column, max_len: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(ids)))


def mask(n_real: Column, max_len: int) -> Column:
    """1 for each real position, then 0 up to ``max_len``."""
    return F.concat(
        F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(max_len) - n_real)
    )


def argmax(scores) -> Column:
    """Position of the greatest score; the first one wins a tie."""
    scores = F.col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
