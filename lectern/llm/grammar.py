"""Token ids of a corpus in one binary file format: Re-Pair grammars, one for each shard.

A shard holds the ids of consecutive documents. Pairs of neighbouring ids that occur often
are replaced by new symbols, the most frequent first, again and again; what is left and the
rules, with the number of ids that each rule stands for, are the shard. Those lengths find
any range of ids without expanding what lies before it.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.byte_bpe import groups_of_texts
from lectern.llm.token_counts import id_coder
from lectern.llm.wordtable import run_places

# Ids of a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
# A pair must occur this often in a shard to become a rule.
LEAST_USES = 8
# A round takes the pairs that occur at least this share of the most frequent one's count.
ROUND_SHARE = 0.125
# Rounds end when one replaces fewer than this share of the symbols.
LEAST_GAIN = 0.005

_MAGIC = 0x31475052
_SLOT_BITS = 18
# Above all pairs, as ids stay below 2**32 - 1.
_NO_PAIR = np.uint64((1 << 64) - 1)


def compress(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The grammar of one shard. ``ends`` are the places after each document's last id.

    Numbers are little-endian and 32 bits wide: the header ``magic, first new symbol, rules,
    symbols, documents, rounds, bytes of a symbol``, each round's first rule, the rules'
    left sides, right sides and lengths, each document's first symbol, then the symbols.
    No rule reaches over the end of a document.
    """
    seq = np.array(ids, np.uint32)
    base = int(seq.max(initial=0)) + 1
    # Where documents start, among the symbols that are left; an empty document has no symbol.
    first = np.r_[0, ends[:-1]].astype(np.int64)
    left, right, rounds = [], [], [0]
    n_rules = 0
    while len(seq) > 1:
        key = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        # A document's last symbol has no pair.
        stops = first[first > 0] - 1
        key[stops[stops < len(key)]] = _NO_PAIR
        pairs, uses = _counted(key)
        if len(pairs) and pairs[-1] == _NO_PAIR:
            pairs, uses = pairs[:-1], uses[:-1]
        most = int(uses.max(initial=0))
        if most < LEAST_USES:
            break
        pairs = pairs[uses >= max(LEAST_USES, int(most * ROUND_SHARE))]
        place, pair = _places(key, pairs)
        kept = _apart(place)
        place, pair = place[kept], pair[kept]
        # Places that overlapped others are gone: a rule must still be used more than once.
        uses = np.bincount(pair, minlength=len(pairs))
        stays = uses[pair] > 1
        place, pair = place[stays], pair[stays]
        if not len(place):
            break
        used = np.flatnonzero(uses > 1)
        symbol = np.zeros(len(pairs), np.uint32)
        symbol[used] = base + n_rules + np.arange(len(used))
        left.append((pairs[used] >> np.uint64(32)).astype(np.uint32))
        right.append((pairs[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        n_rules += len(used)
        rounds.append(n_rules)
        seq[place] = symbol[pair]
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        first -= np.searchsorted(place + 1, first)
        before = len(seq)
        seq = seq[stay]
        if len(place) < before * LEAST_GAIN:
            break
    left = np.concatenate(left) if left else np.zeros(0, np.uint32)
    right = np.concatenate(right) if right else np.zeros(0, np.uint32)
    width = max(2, (int(base + n_rules).bit_length() + 7) // 8)
    head = np.array([_MAGIC, base, n_rules, len(seq), len(ends), len(rounds) - 1, width], "<u4")
    numbers = [head, np.array(rounds[:-1]), left, right, _lengths(base, left, right, rounds)[base:], first]
    packed = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return b"".join(np.asarray(x).astype("<u4").tobytes() for x in numbers) + packed.tobytes()


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.diff(np.r_[edge, len(key)])


def _places(key: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the sorted ``pairs`` starts, and which one it is. A small table by hash
    tells that; only where pairs share a slot of it they are searched."""
    def slot(x):
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    table = np.full(1 << _SLOT_BITS, -1, np.int32)
    own, held = np.arange(len(pairs), dtype=np.int32), slot(pairs)
    table[held] = own
    shared = np.zeros(1 << _SLOT_BITS, bool)
    shared[held[table[held] != own]] = True
    slots = slot(key)
    found = table[slots]
    place = np.flatnonzero(found >= 0)
    found, mine = found[place], key[place]
    same = pairs[found] == mine
    others = np.flatnonzero(~same)
    others = others[shared[slots[place[others]]]]
    found[others] = np.minimum(np.searchsorted(pairs, mine[others]), len(pairs) - 1)
    same[others] = pairs[found[others]] == mine[others]
    return place[same], found[same]


def _apart(place: np.ndarray) -> np.ndarray:
    """Of touching places every other one, from the left."""
    starts = np.r_[True, np.diff(place) > 1]
    run = np.cumsum(starts) - 1
    return (place - place[starts][run]) % 2 == 0 if len(place) else np.zeros(0, bool)


def _lengths(base: int, left: np.ndarray, right: np.ndarray, rounds: list[int]) -> np.ndarray:
    """Ids that every symbol stands for; rules use symbols of earlier rounds only."""
    lengths = np.ones(base + len(left), np.int64)
    for low, high in zip(rounds, rounds[1:]):
        lengths[base + low : base + high] = lengths[left[low:high]] + lengths[right[low:high]]
    return lengths


class Shard:
    """A shard's numbers, ready to be expanded in whole or in part."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<u4", 7).astype(np.int64)
        if head[0] != _MAGIC:
            raise ValueError("not a shard of token ids")
        _, self.base, rules, n_symbols, n_docs, n_rounds, width = head.tolist()
        sizes = np.cumsum([7, n_rounds, rules, rules, rules, n_docs])
        numbers = np.frombuffer(raw, "<u4", int(sizes[-1]))
        starts, self.left, self.right, lengths, self.first = np.split(numbers, sizes[:-1])[1:]
        self.rounds = [*starts.tolist(), rules]
        self.lengths = np.r_[np.ones(self.base, np.int64), lengths]
        packed = np.frombuffer(raw, np.uint8, n_symbols * width, int(sizes[-1]) * 4).reshape(-1, width)
        self.symbols = np.zeros((n_symbols, 4), np.uint8)
        self.symbols[:, :width] = packed
        self.symbols = self.symbols.view("<u4").ravel()
        self.places = np.r_[0, np.cumsum(self.lengths[self.symbols])]

    def ids(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """The ids from place ``low`` to before ``high``; only the symbols that hold them,
        and of their rules only the sides that do, are expanded."""
        high = int(self.places[-1]) if high is None else min(high, int(self.places[-1]))
        if low >= high:
            return np.zeros(0, np.uint32)
        if low == 0 and high == int(self.places[-1]):
            return self._all()
        begin = int(np.searchsorted(self.places, low, "right")) - 1
        end = int(np.searchsorted(self.places, high))
        found, at = self.symbols[begin:end], int(self.places[begin])
        whole = at == low and int(self.places[end]) == high
        for first in range(len(self.rounds) - 2, -1, -1):
            rule = np.flatnonzero(found >= self.base + self.rounds[first])
            if not len(rule):
                continue
            which = found[rule] - self.base
            out = np.repeat(found, np.where(found >= self.base + self.rounds[first], 2, 1))
            place = rule + np.arange(len(rule))
            out[place], out[place + 1] = self.left[which], self.right[which]
            found = out
            if not whole:
                places = at + np.r_[0, np.cumsum(self.lengths[found])]
                begin = int(np.searchsorted(places, low, "right")) - 1
                end = int(np.searchsorted(places, high))
                found, at = found[begin:end], int(places[begin])
        return found

    def _all(self) -> np.ndarray:
        """All ids; each rule is expanded once, from the rules of earlier rounds."""
        begin = np.cumsum(self.lengths) - self.lengths
        ids = np.empty(int(self.lengths.sum()), np.uint32)
        ids[: self.base] = np.arange(self.base)
        for low, high in zip(self.rounds, self.rounds[1:]):
            sides = np.stack([self.left[low:high], self.right[low:high]], 1).ravel()
            found = ids[run_places(begin[sides], self.lengths[sides])]
            at = int(begin[self.base + low])
            ids[at : at + len(found)] = found
        return ids[run_places(begin[self.symbols], self.lengths[self.symbols])]

    def documents(self) -> np.ndarray:
        """The place of each document's first id, and the place after the last one's."""
        return np.r_[self.places[self.first], self.places[-1]]


class _Writer:
    """Gathers the ids of consecutive documents and gives shards."""

    def __init__(self, part: int):
        self.part, self.shard, self.start = part, 0, 0
        self.clear()

    def clear(self):
        self.docs, self.sizes, self.held = [], [], []
        self.n = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.n and self.n + len(ids) > SHARD_IDS:
            yield self.give()
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n += len(ids)

    def give(self) -> pa.RecordBatch:
        grammar = compress(np.concatenate(self.held), np.cumsum(self.sizes))
        row = {
            "part": pa.array([self.part], pa.int32()),
            "shard": pa.array([self.shard], pa.int64()),
            "start": pa.array([self.start], pa.int64()),
            "n_ids": pa.array([self.n], pa.int64()),
            "doc_ids": pa.array([self.docs], pa.list_(pa.int64())),
            "grammar": pa.array([grammar], pa.binary()),
        }
        self.shard += 1
        self.start += self.n
        self.clear()
        return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


SHARD_SCHEMA = "part int, shard bigint, start bigint, n_ids bigint, doc_ids array<bigint>, grammar binary"


def word_ids(path: str, end: int | None = None) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Makes, once in each worker, what encodes texts by a word-end BPE vocabulary file and
    appends the id ``end``."""

    def start():
        bpe = id_coder(path)
        tail = b"" if end is None else end.to_bytes(4, "little")
        return lambda texts: [np.frombuffer(ids + tail, "<u4") for ids in bpe.encode(texts)]

    return start


def write_ids(docs: DataFrame, path: str, start: Callable) -> None:
    """Write the ids of every row's whole ``text`` to ``path``, in ascending ``doc_id`` order.

    Rows are dealt out by ranges of ``doc_id`` and encoded where they land, so that texts
    move once. Rows without an id come first; rows of one id are ordered by their text, and
    a digest in the range key lets many of them be parted. A null text is an empty one;
    repeated rows are written as often as they occur; other columns are ignored. ``path``
    then holds ``shards`` (see ``SHARD_SCHEMA``) and ``parts``, the ids before each part.
    """
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = start()
        writer = _Writer(TaskContext.get().partitionId())
        for batch in batches:
            at = 0
            for texts in groups_of_texts(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc_id, found in zip(ids, encode(texts)):
                    yield from writer.add(doc_id, found)
        if writer.docs:
            yield writer.give()

    rows = docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text")).withColumn("deal", F.rand(1))
    # Equal rows are told apart by their draw alone, so it decides nothing else.
    ordered = rows.repartitionByRange("doc_id", "mark", "deal").sortWithinPartitions("doc_id", "mark", "text")
    ordered.select("doc_id", "text").mapInArrow(shards, SHARD_SCHEMA).write.parquet(f"{path}/shards")
    # One row for each writing task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts.coalesce(1).write.parquet(f"{path}/parts")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with the place of their first id among all ids."""
    parts = spark.read.schema("part int, before bigint").parquet(f"{path}/parts")
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    return shards.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document written to ``path``.

    ``start`` is the number of ids of all documents before it, ``ids`` holds its own as
    little-endian unsigned 32-bit integers.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("grammar")[row].as_py())
                places = shard.documents()
                raw = shard.ids().astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values,
                        pa.array(places[:-1] + batch.column("start")[row].as_py()),
                        pa.array(np.diff(places)),
                        pa.Array.from_buffers(
                            pa.binary(), len(places) - 1,
                            [None, pa.py_buffer((places * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)],
                        ) if len(raw) < 1 << 31 else pa.array([raw[4 * a : 4 * b] for a, b in zip(places, places[1:])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return _shards(spark, path).select("start", "doc_ids", "grammar").mapInArrow(expand, schema)


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """``range_id, start, ids`` of each wanted range ``range_id, start, size`` of places.

    A range over several shards comes in as many rows, each with the place of its first
    id; what lies beyond the last id is left out, as are empty ranges and ones with nulls.
    A shard expands only the symbols that a range needs.
    """
    step = F.lit(SHARD_IDS)
    wanted = ranges.select("range_id", F.greatest("start", F.lit(0)).alias("low"), (F.col("start") + F.col("size")).alias("high"))
    wanted = wanted.where("low < high")
    shards = _shards(spark, path).select("part", "shard", "start", "n_ids", "grammar")
    # Both sides are dealt by steps of the places, so ranges meet only shards near them.
    ends = shards.select("part", "shard", "start", (F.col("start") + F.col("n_ids")).alias("end"))
    total = ends.agg(F.max("end")).first()[0] or 0
    wanted = wanted.withColumn("high", F.least("high", F.lit(total))).where("low < high")

    def steps(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) / step), F.floor((F.col(high) - 1) / step)))

    near = wanted.withColumn("step", steps("low", "high")).join(
        ends.where("start < end").withColumn("step", steps("start", "end")), "step"
    )
    met = near.where("low < end AND high > start").select("range_id", "low", "high", "part", "shard").distinct()
    found = met.join(shards.drop("n_ids"), ["part", "shard"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            starts, ids = [], []
            for row in range(batch.num_rows):
                start = batch.column("start")[row].as_py()
                if held[0] != start:
                    held = (start, Shard(batch.column("grammar")[row].as_py()))
                low = max(batch.column("low")[row].as_py(), start)
                starts.append(low)
                ids.append(held[1].ids(low - start, batch.column("high")[row].as_py() - start).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("range_id"), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["range_id", "start", "ids"]
            )

    kind = dict(ranges.dtypes)["range_id"]
    ordered = found.select("range_id", "low", "high", "start", "grammar").sortWithinPartitions("start")
    return ordered.mapInArrow(expand, f"range_id {kind}, start bigint, ids binary")
