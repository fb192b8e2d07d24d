"""Byte-level BPE: ids of whole texts by the ranks of a vocabulary file, and back.

The dealt form, Spark higher-order functions that fold ranked merges over the distinct
words, is ``fold_words``; see the README for why the query spells its distinct words in
Arrow batches instead. Both give the ids of the published library.
"""

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import annotate, per_text
from lectern.llm.merges import PairTable, merge
from lectern.llm.pretokens import Splitter

# Bytes of distinct words and their ids that a task remembers, about.
REMEMBERED_BYTES = 48 << 20
# What an entry takes beside its letters and ids, about.
_ENTRY = 150


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(piece): int(rank) for piece, rank in pairs}


class ByteBpe:
    """Encoder and decoder; built once in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = Splitter(pattern)
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.table = PairTable(*zip(*_splits(ranks))) if any(len(p) > 1 for p in ranks) else PairTable([], [], [], [])
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words (32-bit, as bytes), all spelled at once."""
        coded = [w.encode() for w in words]
        # Ids take four bytes for each byte of a word at the most.
        self.held += sum(5 * len(b) for b in coded) + _ENTRY * len(coded)
        whole = [self.ranks.get(b) for b in coded]
        self.known.update((w, r.to_bytes(4, "little")) for w, r in zip(words, whole) if r is not None)
        words = [w for w, r in zip(words, whole) if r is None]
        coded = [b for b, r in zip(coded, whole) if r is None]
        if not words:
            return
        symbols = self.bytes[np.frombuffer(b"".join(coded), np.uint8)]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        ids, counts = merge(symbols, np.array([len(b) for b in coded]), self.table)
        raw = ids.astype("<i4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        self.known.update((w, raw[low:high]) for w, low, high in zip(words, [0, *ends], ends))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.words(text) for text in texts]
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        fresh = set().union(*words).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, w)), "<i4") for w in words]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _splits(ranks):
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                yield left, right, rank, rank


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def groups_of_texts(texts: pa.Array, limit: int = 1 << 20):
    """Texts of a batch as strings, about ``limit`` bytes at a time; null is empty."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def round_trip(docs: DataFrame, path: str, pattern: str, name: str = "bpe") -> DataFrame:
    """``docs`` with ``name``: struct of ``ids array<int>`` and ``decoded binary``.

    Every match of ``pattern`` is encoded by itself, without special tokens; ``decoded``
    is made from the ids. Null and empty texts have no ids. Other columns pass unchanged,
    rows and repeated ids included; an older column ``name`` is replaced. The vocabulary
    file is read by each worker, so ``path`` must be installed with the library.
    """

    def start():
        bpe = coder(path, pattern)

        def work(texts):
            ids, sizes, decoded = [], [], []
            for group in groups_of_texts(texts):
                for found in bpe.encode(group):
                    ids.append(found)
                    sizes.append(len(found))
                    decoded.append(bpe.decode(found))
            places = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=places[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return {
                "ids": pa.ListArray.from_arrays(pa.array(places), pa.array(flat, pa.int32())),
                "decoded": pa.array(decoded, pa.binary()),
            }

        return work

    return annotate(docs, name, per_text(start, "struct<ids:array<int>,decoded:binary>"))


def encode_checked(docs: DataFrame, path: str, pattern: str, name: str = "bpe") -> DataFrame:
    """``docs`` with ``name``: struct of ``ids array<int>`` and ``same boolean``, whether the
    ids decode to the text's bytes.

    As ``round_trip``, but the decoded bytes stay in the worker, and results leave it a
    bounded number of texts at a time, whatever the rows' number and size.
    """
    kept = [c for c in docs.columns if c != name]

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            at = 0
            for group in groups_of_texts(batch.column(kept.index("text")), 1 << 18):
                ids = bpe.encode(group)
                places = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=places[1:])
                same = [bpe.decode(i) == text.encode() for i, text in zip(ids, group)]
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(ids), pa.int32()))
                rows = batch.slice(at, len(group))
                at += len(group)
                coded = pa.StructArray.from_arrays([lists, pa.array(same)], names=["ids", "same"])
                yield pa.RecordBatch.from_arrays([*rows.columns, coded], names=[*kept, name])

    coded_type = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("same", T.BooleanType())
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, coded_type)])
    return docs.select(*kept).mapInArrow(run, schema)


def digests(coded: DataFrame, name: str = "bpe") -> DataFrame:
    """Number of tokens and the two digests of a coded table."""
    ids = F.col(f"{name}.ids")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(f"{name}.decoded"), 256).alias("decoded_sha256"),
    )


def rank_literal(ranks: dict[bytes, int], buckets: int = 1 << 14) -> Column:
    """The rank map as a literal: an array of small maps, found by the piece's hash."""
    import zlib

    held: list[list] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        held[zlib.crc32(piece) % buckets].append(f"'{piece.hex()}',{rank}")
    return F.expr("array(" + ",".join(f"map({','.join(x)})" if x else "map('',-1)" for x in held) + ")")


def fold_words(words: DataFrame, ranks: dict[bytes, int], buckets: int = 256) -> DataFrame:
    """``word`` and ``ids array<int>`` of distinct non-empty words, by higher-order functions.

    Each step of the fold finds the lowest rank among neighbouring byte strings and joins
    the leftmost such pair. Meant for vocabularies whose literal fits a plan.
    """
    table = rank_literal(ranks, buckets)

    def rank(piece):
        slot = F.pmod(F.crc32(F.unhex(piece)), F.lit(buckets)).cast("int")
        return F.try_element_at(F.get(table, slot), piece)

    hexed = F.hex(F.encode("word", "UTF-8"))
    letters = F.transform(
        F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda i: F.lower(F.substring(hexed, i * 2 + 1, F.lit(2)))
    )

    def step(pieces, _):
        pairs = F.zip_with(
            F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: rank(F.concat(a, b))
        )
        least = F.array_min(pairs)
        at = F.array_position(pairs, least).cast("int")
        joined = F.concat(
            F.slice(pieces, F.lit(1), at - 1),
            F.array(F.concat(F.element_at(pieces, at), F.element_at(pieces, at + 1))),
            F.slice(pieces, at + 2, F.size(pieces)),
        )
        return F.when((F.size(pieces) < 2) | least.isNull(), pieces).otherwise(joined)

    whole = F.array(F.lower(hexed))
    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(letters), F.lit(2))), letters, step)
    found = F.when(rank(F.lower(hexed)).isNotNull(), whole).otherwise(folded)
    return words.select("word", F.transform(found, rank).alias("ids"))
