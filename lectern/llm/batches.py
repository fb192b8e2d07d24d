"""Arrow batches of texts as byte arrays, cut into slices of bounded size."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

# Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and where each row starts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, body = texts.buffers()
    starts = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def row_ranges(starts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or one longer row."""
    low, rows = 0, len(starts) - 1
    while low < rows:
        high = int(np.searchsorted(starts, starts[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def text_slices(
    texts: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """``data, starts, first row, last row`` of each slice of a batch."""
    data, starts = byte_view(texts)
    for low, high in row_ranges(starts, limit):
        first = starts[low]
        yield data[first : starts[high]], starts[low : high + 1] - first, low, high


def per_text(start: Callable[[], Callable[[pa.Array], list]], schema: str) -> Callable[..., Column]:
    """A column function of texts. ``start`` runs once a task and returns what turns an
    Arrow array of texts into the columns of ``schema`` (a struct), in order."""

    @arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        kind = None
        for texts in batches:
            columns = work(texts)
            kind = kind or pa.struct([(name, column.type) for name, column in columns.items()])
            yield pa.StructArray.from_arrays(list(columns.values()), fields=list(kind))

    return run


def annotate(docs: DataFrame, name: str, function: Callable[..., Column], text: str = "text") -> DataFrame:
    """``docs`` with one more struct column; a column of that name is replaced."""
    return docs.withColumn(name, function(text))


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))
