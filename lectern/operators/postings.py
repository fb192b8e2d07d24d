"""The words of every row, cut once: what vocabulary, encoder, fit and score read."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import words

# Places that one number holds as bits; the sign stays out of it.
_BITS = 63
# Words that a task counts at a time, about; a longer row is taken alone.
WORDS_AT_ONCE = 1 << 18


def postings(df: DataFrame, keep: tuple[str, ...] = ("label",), first: int = 126) -> DataFrame:
    """``doc_id, *keep, n_words, word, n, early`` of whole texts: a row for each distinct word.

    ``n`` is how often the row's text holds the word, ``early`` its places among the first
    ``first`` words as bits, ``n_words`` the words of the text. A text without words has one
    row with a null word and ``n`` 0. ``doc_id`` is unique. The JVM cuts the words; a row's
    words are counted where the row is, so nothing is shuffled and a text's rows stay together.
    """
    cut = df.select("doc_id", *keep, words("text").alias("words"))
    lows = range(0, first, _BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in lists_at_once(batch.column("words")):
                own = batch.slice(low, high - low)
                row, n_words, word, n, early = _counted(own.column("words"), lows, first)
                kept = own.drop_columns(["words"]).take(pa.array(row))
                places = pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(lows))
                bits = pa.ListArray.from_arrays(places, pa.array(early.ravel()))
                columns = [*kept.columns, pa.array(n_words.astype(np.int32)), word, pa.array(n), bits]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "n_words", "word", "n", "early"])

    schema = T.StructType([cut.schema[c] for c in ("doc_id", *keep)])
    schema = schema.add("n_words", T.IntegerType()).add("word", T.StringType()).add("n", T.LongType())
    return cut.mapInArrow(run, schema.add("early", T.ArrayType(T.LongType())))


def lists_at_once(lists: pa.ListArray, most: int = WORDS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` words together, or of one longer row."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    low = 0
    while low < len(lists):
        upto = (ends[low - 1] if low else 0) + most
        high = max(low + 1, int(np.searchsorted(ends, upto, "right")))
        yield low, high
        low = high


def _counted(lists: pa.ListArray, lows: range, first: int) -> tuple:
    """``row, n_words, word, n, early`` of lists of words, by row; see ``postings``."""
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # A row without words has one of no word, which comes last in the dictionary.
    bare = np.flatnonzero(sizes == 0)
    row, place = np.r_[row, bare], np.r_[place, np.full(len(bare), first)]
    code = np.r_[code, np.full(len(bare), len(coded.dictionary))]
    key = row * (len(coded.dictionary) + 1) + code
    order = np.argsort(key, kind="stable")
    row, place, code, key = row[order], place[order], code[order], key[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[edge, len(key)])
    row, code = row[edge], code[edge]
    early = np.zeros((len(edge), len(lows)), np.int64)
    for i, low in enumerate(lows):
        mine = (place >= low) & (place < min(low + _BITS, first))
        bits = np.where(mine, np.int64(1) << np.where(mine, place - low, 0), 0)
        early[:, i] = np.bitwise_or.reduceat(bits, edge)
    some = code < len(coded.dictionary)
    word = coded.dictionary.take(pa.array(code, mask=~some))
    return row, sizes[row], word, np.where(some, n, 0), early


def is_postings(df: DataFrame) -> bool:
    return {"word", "n", "early"} <= set(df.columns)


def early_words(rows: DataFrame, carry: tuple[str, ...], limit: int) -> DataFrame:
    """``doc_id, *carry, at_word, word`` of the first ``limit`` words, a row for each place.

    A row without words keeps one, with nulls. Postings that were cut with fewer first places
    than ``limit`` are an error.
    """
    places = F.expr(
        f"flatten(transform(early, (bits, i) -> transform("
        f"filter(sequence(0, {_BITS - 1}), b -> (shiftright(bits, b) & 1L) = 1L), b -> i * {_BITS} + b)))"
    )
    enough = F.when(F.size("early") * _BITS < limit, F.raise_error(F.lit("postings hold too few first places"))).otherwise(places)
    reached = F.col("word").isNull() | F.exists("early", lambda bits: bits != 0)
    return (
        rows.where(reached)
        .select("doc_id", *carry, "word", F.explode_outer(F.filter(enough, lambda at: at < limit)).alias("at_word"))
        .where("at_word IS NOT NULL OR word IS NULL")
    )


def reached_words(rows: DataFrame, carry: tuple[str, ...], limit: int) -> DataFrame:
    """``doc_id, *carry, at_word, word`` of the first ``limit`` words, a row for each distinct
    word: ``at_word`` holds its places as bits, see ``places_of``.

    A row without words keeps one. Postings that were cut with fewer first places than
    ``limit`` are an error.
    """
    masks = F.array(*[F.lit((1 << max(min(limit - low, _BITS), 0)) - 1).cast("bigint") for low in range(0, max(limit, 1), _BITS)])
    own = F.transform("early", lambda bits, i: bits.bitwiseAND(F.coalesce(F.get(masks, i), F.lit(0).cast("bigint"))))
    enough = F.when(F.size("early") * _BITS < limit, F.raise_error(F.lit("postings hold too few first places"))).otherwise(own)
    found = rows.select("doc_id", *carry, enough.alias("at_word"), "word")
    return found.where(F.col("word").isNull() | F.exists("at_word", lambda bits: bits != 0))


def places_of(at_word: Column) -> Column:
    """The places that the bits of ``reached_words`` stand for."""
    none = F.array().cast("array<int>")

    def places(bits, i):
        # Most words have one place.
        one = F.array(F.round(F.log2(bits)).cast("int"))
        many = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda b: F.getbit(bits, b) == 1)
        found = F.when(bits == 0, none).when(F.bit_count(bits) == 1, one).otherwise(many)
        return F.transform(found, lambda b: i * _BITS + b)

    return F.flatten(F.transform(at_word, places))


def starts_row(early: str = "early", word: str = "word"):
    """Whether this is the one row of its text that holds the first word, or no word."""
    return F.col(word).isNull() | (F.get(early, F.lit(0)).bitwiseAND(F.lit(1)) == 1)
