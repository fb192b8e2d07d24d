"""Language of whole texts: multinomial naive Bayes on hashed character n-grams."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import annotate, byte_view, per_text, row_ranges, strings
from lectern.llm.vectors import add_up
from lectern.llm.words import mix

UNKNOWN = "und"
ORDERS = (1, 2, 3)
# Buckets for each order, as a power of two.
BUCKET_BITS = 14
# The matrix of log probabilities that is broadcast never exceeds this.
MATRIX_BYTES = 64 << 20
# Characters worked on at once; a longer text is scored in overlapping pieces.
PIECE = 1 << 18

_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case letter of each code point below 65536, a blank for anything else."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in [*range(0xD800), *range(0xE000, 1 << 16)]:
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _codes(data: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes < 1 << 16
    return np.where(small, _folded()[np.where(small, codes, 32)], codes)


def _features(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character (the last ones have none)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.full(n, np.uint64(order))
    for j in range(order):
        total = total * np.uint64(0x100000001B3) + codes[j : j + n]
    level = ORDERS.index(order)
    return (mix(total) >> np.uint64(64 - bits)).astype(np.int64) + (level << bits)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``codes, starts, first row`` of slices; a long text comes in pieces that overlap by
    the longest order less one, so that no n-gram is lost, and counts ``overlap`` of none."""
    data, starts = byte_view(texts)
    for low, high in row_ranges(starts, PIECE):
        part = data[starts[low] : starts[high]]
        lead = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
        yield _codes(part), lead[starts[low : high + 1] - starts[low]], low


def ngrams(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``buckets, rows`` for each order and piece of a batch; n-grams stay within a text."""
    for codes, starts, low in _pieces(texts):
        for at in range(0, max(len(codes), 1), PIECE):
            piece = codes[at : at + PIECE + ORDERS[-1] - 1]
            row = np.searchsorted(starts, np.arange(at, at + len(piece)), "right") - 1
            for order in ORDERS:
                buckets = _features(piece, order, bits)[:PIECE]
                inside = row[: len(buckets)] == row[order - 1 : order - 1 + len(buckets)]
                yield buckets[inside], row[: len(buckets)][inside] + low


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, log priors and ``buckets x languages`` log probabilities."""

    languages: tuple[str, ...]
    priors: np.ndarray
    matrix: np.ndarray
    bits: int


def fit(rows: DataFrame, bits: int = BUCKET_BITS, smoothing: float = 0.5) -> LanguageModel:
    """Counts of every n-gram of every row with a ``lang`` (and all of their texts).

    Each task counts its own rows; the count vectors are added up on the executors and
    only the languages' sums, ``len(ORDERS) << bits`` numbers each, come to the driver. The
    number of languages must be bounded: a matrix beyond ``MATRIX_BYTES``, with the default
    ``bits`` that of more than 341 languages, is an error. Rows without language teach nothing; rows
    without text count for the prior alone.
    """
    rows = rows.where(F.col("lang").isNotNull()).select("lang", "text")
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if (len(ORDERS) << bits) * len(languages) * 4 > MATRIX_BYTES:
        raise ValueError(f"{len(languages)} languages need a smaller value of bits than {bits}")
    width = len(ORDERS) << bits
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counts = np.zeros((len(place), width + 1))
        for batch in batches:
            label = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            if not len(label):
                continue
            counts[:, width] += np.bincount(label, minlength=len(place))
            for buckets, row in ngrams(batch.column("text"), bits):
                flat = np.bincount(label[row] * (width + 1) + buckets, minlength=counts.size)
                counts += flat.reshape(counts.shape)
        seen = np.flatnonzero(counts[:, width])
        yield pa.RecordBatch.from_arrays(
            [strings([languages[i] for i in seen]), pa.array([part] * len(seen), pa.int64()), pa.array([counts[i].tobytes() for i in seen], pa.binary())],
            names=["key", "part", "vector"],
        )

    found = {r.key: np.frombuffer(r.vector) for r in add_up(rows.mapInArrow(count, "key string, part bigint, vector binary")).collect()}
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((width, 0), np.float32), bits)
    table = np.stack([found[lang] for lang in languages])
    logs = np.empty((width, len(languages)), np.float32)
    for level in range(len(ORDERS)):
        part = slice(level << bits, level + 1 << bits)
        block = table[:, part] + smoothing
        logs[part] = np.log(block / block.sum(1, keepdims=True)).T
    return LanguageModel(tuple(languages), np.log(table[:, width] / table[:, width].sum()), logs, bits)


def scores(texts: pa.Array, model: LanguageModel) -> np.ndarray:
    """Log posterior, up to a constant, of each language for each text."""
    total = np.tile(model.priors, (len(texts), 1))
    for buckets, row in ngrams(texts, model.bits):
        if not len(row):
            continue
        # One sparse row of bucket counts for each text, times the matrix.
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[edge]] += np.add.reduceat(model.matrix[buckets], edge, axis=0, dtype=np.float64)
    return total


def identify(docs: DataFrame, model: LanguageModel, name: str = "language") -> DataFrame:
    """``docs`` with ``name``: struct of ``lang_pred`` and ``score``.

    ``und`` with score 0 for a null text, one without a letter, or a model that saw no
    language. The score is the posterior of the language given. Whole texts are read;
    rows, repeated or not, and other columns pass unchanged, an older column ``name`` is
    replaced. The model goes to the tasks as a broadcast of bounded size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = held.value

        def work(texts):
            has = np.array([bool(t.as_py() and _LETTER.search(t.as_py())) for t in texts], bool)
            if not learned.languages or not len(texts):
                return {"lang_pred": strings([UNKNOWN] * len(texts)), "score": pa.array(np.zeros(len(texts)))}
            logs = scores(texts, learned)
            best = logs.argmax(1)
            share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            names = np.array([*learned.languages, UNKNOWN], object)
            return {
                "lang_pred": strings(names[np.where(has, best, len(learned.languages))]),
                "score": pa.array(np.where(has, share, 0.0)),
            }

        return work

    return annotate(docs, name, per_text(start, "struct<lang_pred:string,score:double>"))


def fold(parts: int, column: str = "doc_id") -> Column:
    """Which of ``parts`` folds a row is in, by the CRC-32 of its id as text."""
    return F.crc32(F.col(column).cast("string")) % parts


def held_out(parts: int, fold_out: int, column: str = "doc_id") -> Column:
    """Whether a row is in the fold kept out; a row without id is not."""
    return F.coalesce(fold(parts, column) == fold_out, F.lit(False))
