"""Which tokens of two tokenizers cover the same bytes, found by pointer jumping.

Both tokenizers cut the same bytes. Each token points to the token that reaches farthest to
the right among those that overlap it; doubling the pointers ends at the last token of its
connected group, whose label all share. Groups so end where both tokenizers end a token.
"""

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.batches import annotate, byte_view, longs, per_text, strings
from lectern.llm.byte_bpe import ByteBpe, groups_of_texts, read_ranks
from lectern.plans.shared import saved

# Letters of text that are aligned together, about; a longer text is taken alone.
BLOCK = 1 << 18
# Letters that the piece model encodes at once, about; its merges slow down over long texts.
PART = 256
# Ids of A whose links are found together, about; a longer text is taken alone.
MARKS_AT_ONCE = 1 << 18
# Links that are written out at once.
LINKS_AT_ONCE = 1 << 19
# In a group with more links than this, equal ids are counted before they are paired.
PLAIN_LINKS = 4096
# Pairs that a task counts before it hands them on.
PAIRS_HELD = 1 << 18
# Most frequent pairs whose counts every task holds (16 bytes each); the others are joined.
HEAD_PAIRS = 1 << 20


class Pieces:
    """The bytes of each id of a vocabulary, all in one array."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(sizes.sum())]


class ByteSide:
    """Byte-level BPE of a space and the text, special strings read as plain text."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.bpe = ByteBpe(ranks, pattern)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = Pieces(pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.bpe.encode([" " + t for t in texts])


class PieceSide:
    """A sentencepiece model, which adds the space itself.

    Texts are cut before spaces that follow another letter, where no piece of the model goes on.
    White space at a text's end stays with what is before it.
    """

    _parts = re.compile(rf"(?s).{{1,{PART}}} *+[^ ]*+(?: +\Z)?").findall

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.pieces = Pieces(pieces)
        # Whether no piece goes on behind a letter with a space, and all spaces are kept.
        odd = "  a   b "
        kept = b"".join(pieces[i] for i in self.model.encode(odd)) == b" " + odd.encode()
        self.parted = kept and not any(re.search(b"[^ ] ", piece) for piece in pieces)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self._parts(" " + t) if self.parted and t else [" " + t] for t in texts]
        found = self.model.encode([part[1:] for part in chain.from_iterable(parts)], num_threads=1)
        ends = np.cumsum([len(ids) for ids in found])
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]) if len(ends) else 0)
        return np.split(ids, ends[np.cumsum([len(x) for x in parts])[:-1] - 1])


@lru_cache(maxsize=2)
def _sides(byte_path: str, pattern: str, piece_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(byte_path, pattern), PieceSide(piece_path)


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Label of each token of A, then of B: the number of its group, in order of the bytes.

    ``a_ends`` and ``b_ends`` are rising places of the tokens' last bytes plus one; both
    tokenizers cover the same bytes without gaps.
    """
    n_a, n_b = len(a_ends), len(b_ends)
    if not n_a:
        return np.zeros(0, np.int64)
    # The last token of the other side that starts before this one ends holds its last byte,
    # so no overlapping token reaches farther. Of two that end together B's is the terminal.
    of_a = np.searchsorted(b_ends, a_ends - 1, "right")
    of_b = np.searchsorted(a_ends, b_ends - 1, "right")
    a, b = np.arange(n_a), n_a + np.arange(n_b)
    point = np.concatenate([
        np.where(b_ends[of_a] >= a_ends, n_a + of_a, a),
        np.where(a_ends[of_b] > b_ends, of_b, b),
    ])
    while True:
        farther = point[point]
        if np.array_equal(farther, point):
            break
        point = farther
    terminal = np.zeros(n_a + n_b, bool)
    terminal[point] = True
    # Terminals are tokens of B, in order of the bytes.
    return (np.cumsum(terminal) - 1)[point]


# Bytes of an id as text with a sign behind it: one number, so ids have seven digits at most.
_WIDTH = 8


@lru_cache(maxsize=2)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size``, left-aligned, and how many each has."""
    text = np.array([str(i) for i in range(size)], f"S{_WIDTH}")
    return text.view("<u8"), np.char.str_len(text)


# By the number of digits: which bytes hold them and the sign behind them.
_SHOWN = np.tri(_WIDTH, dtype=np.uint8).view("<u8").ravel()


def _written(ids_a, ids_b, groups_a, groups_b, n_groups, first) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of each text; ``first`` are the texts' first groups and the end."""
    sizes = np.stack([np.bincount(groups_a, minlength=n_groups), np.bincount(groups_b, minlength=n_groups)], 1)
    starts = np.cumsum(sizes.ravel()).reshape(-1, 2) - sizes
    n = len(ids_a) + len(ids_b)
    ids = np.empty(n, np.int64)
    at_a = starts[groups_a, 0] + _within(sizes[:, 0])
    at_b = starts[groups_b, 1] + _within(sizes[:, 1])
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark = np.full(n, ord(","), np.uint64)
    mark[starts[:, 0] + sizes[:, 0] - 1] = ord("|")
    mark[starts[:, 1] + sizes[:, 1] - 1] = ord(";")
    digits, width = _decimals(1 << 17)
    wide = width[ids]
    table = digits[ids] | mark << (8 * wide).astype(np.uint64)
    raw = table.view(np.uint8)[_SHOWN[wide].view(bool)].tobytes()
    places = np.r_[0, np.cumsum(wide + 1)][np.r_[starts[:, 0], n][first]]
    return [raw[low : max(high - 1, low)] for low, high in zip(places[:-1].tolist(), places[1:].tolist())]


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _blocks(sides, texts: pa.Array) -> Iterator[tuple]:
    """Bounded numbers of texts at a time: ids of A and how many each text has, the same of
    B, the groups' sizes in both, how many groups each text has, and the groups as text."""
    a_side, b_side = sides
    none = np.zeros(0, np.int32)
    for block in groups_of_texts(texts, BLOCK):
        a_all, b_all = a_side.encode(block), b_side.encode(block)
        wholes = [b" " + t.encode() for t in block]
        whole = np.frombuffer(b"".join(wholes), np.uint8)
        spelled = b_side.pieces.spelled(np.concatenate(b_all))
        at_whole = at_spelled = 0
        for i, text in enumerate(wholes):
            # A's tokens are cut from these bytes, so their number tells all; B may change them.
            n_b = int(b_side.pieces.sizes[b_all[i]].sum())
            same = len(text) > 1 and a_side.pieces.sizes[a_all[i]].sum() == n_b == len(text) and np.array_equal(
                spelled[at_spelled : at_spelled + n_b], whole[at_whole : at_whole + n_b]
            )
            at_whole += len(text)
            at_spelled += n_b
            if not same:
                a_all[i] = b_all[i] = none
        a_ids, b_ids = np.concatenate(a_all), np.concatenate(b_all)
        label = group_ends(np.cumsum(a_side.pieces.sizes[a_ids]), np.cumsum(b_side.pieces.sizes[b_ids]))
        n_groups = int(label.max(initial=-1)) + 1
        groups_a, groups_b = label[: len(a_ids)], label[len(a_ids) :]
        n_a, n_b = [len(x) for x in a_all], [len(x) for x in b_all]
        ends = np.cumsum(n_a)
        first = np.r_[0, np.where(ends > 0, np.r_[groups_a, -1][ends - 1] + 1, 0)]
        written = _written(a_ids, b_ids, groups_a, groups_b, n_groups, first)
        sizes_a, sizes_b = np.bincount(groups_a, minlength=n_groups), np.bincount(groups_b, minlength=n_groups)
        yield a_ids, n_a, b_ids, n_b, sizes_a, sizes_b, np.diff(first), written


def align(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, name: str = "aligned") -> DataFrame:
    """``docs`` with ``name``: struct of both sides' ids and of the groups they form.

    ``a_ids`` and ``b_ids`` are the ids of the whole text, ``a_sizes`` and ``b_sizes`` how
    many of them each group takes in turn, ``groups`` the same as text. Null and empty texts,
    and texts whose joined token bytes are not a space and the text on both sides, have no
    tokens. Other columns and repeated rows pass unchanged; an older column ``name`` is
    replaced.
    """

    def start():
        sides = _sides(byte_path, pattern, piece_path)

        def work(texts):
            parts = list(_blocks(sides, texts))
            columns = [_lists([(p[i], p[j]) for p in parts]) for i, j in ((0, 1), (2, 3), (4, 6), (5, 6))]
            written = strings([w.decode() for p in parts for w in p[7]])
            return dict(zip(["a_ids", "b_ids", "a_sizes", "b_sizes", "groups"], [*columns, written]))

        return work

    schema = "struct<a_ids:array<int>,b_ids:array<int>,a_sizes:array<int>,b_sizes:array<int>,groups:string>"
    return annotate(docs, name, per_text(start, schema))


def mark(
    docs: DataFrame, byte_path: str, pattern: str, piece_path: str, pairs_held: int = PAIRS_HELD
) -> tuple[DataFrame, DataFrame]:
    """The rows' alignments in a narrow form, and how many rows of each task hold each pair.

    The first table is ``row, doc_id, n_a, n_b, n_groups, a_marks, b_marks, groups_sha256``:
    a mark is twice an id, plus one at the end of a group, in three bytes; the groups' text is
    digested (empty without tokens); ``row`` numbers the rows, whatever their ids. The second
    is ``pair, n`` with a row for each task and pair, to be added up. One pass writes both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_path, pattern, piece_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            at = 0
            kind = batch.schema.field("doc_id").type
            for a_ids, n_a, b_ids, n_b, sizes_a, sizes_b, each, written in _blocks(sides, batch.column("text")):
                own = batch.slice(at, len(n_a))
                at += len(n_a)
                marks = [_packed(ids, sizes, n) for ids, sizes, n in ((a_ids, sizes_a, n_a), (b_ids, sizes_b, n_b))]
                digests = strings([sha256(w).hexdigest() if n else "" for w, n in zip(written, n_a)])
                columns = [own.column("row"), own.column("doc_id"), longs(n_a), longs(n_b), longs(each), *marks, digests]
                none = [pa.nulls(own.num_rows, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*columns, *none], names=_MARKED)
                for _, pair, _ in _by_row(pa.RecordBatch.from_arrays(marks, names=["a_marks", "b_marks"])):
                    held.append(_counted(pair))
                    size += len(held[-1][0])
                if size > 2 * pairs_held:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > pairs_held:
                        yield _pair_rows(*held[0], kind)
                        held, size = [], 0
        if held:
            yield _pair_rows(*_merged(held), kind)

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = (
        f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, a_marks binary, b_marks binary, "
        "groups_sha256 string, pair bigint, n bigint"
    )
    both = saved(rows.mapInArrow(run, schema), "marked")
    return both.where("row IS NOT NULL").drop("pair", "n"), both.where("row IS NULL").select("pair", "n")


_MARKED = ["row", "doc_id", "n_a", "n_b", "n_groups", "a_marks", "b_marks", "groups_sha256", "pair", "n"]


def _pair_rows(pair: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(pair), k) for k in kinds], pa.array(pair), pa.array(n)], names=_MARKED)


def _packed(ids: np.ndarray, sizes: np.ndarray, n: list[int]) -> pa.Array:
    """Marks of each text, three bytes each."""
    marks = ids.astype("<u4") * 2
    marks[np.cumsum(sizes) - 1] += 1
    raw = marks.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    places = pa.py_buffer((np.r_[0, np.cumsum(n)] * 3).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(n), [None, places, pa.py_buffer(raw)])


def _lists(parts) -> pa.Array:
    flat = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
    sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
    places = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat.astype(np.int32)))


def _marks(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a side of marked rows, the sizes of their groups, and the row of each group."""
    data, places = byte_view(batch.column(side))
    marks = np.zeros((len(data) // 3, 4), np.uint8)
    marks[:, :3] = data.reshape(-1, 3)
    marks = marks.view("<u4").ravel()
    ends = np.flatnonzero(marks & 1)
    return marks.astype(np.int64) >> 1, np.diff(np.r_[-1, ends]), np.searchsorted(places // 3, ends, "right") - 1


def _links(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """``row, pair, times`` of the links of a batch of marked rows, in blocks of bounded
    size; a pair may come again. A pair is A's id times 2**32 plus B's; ``times`` of None are
    ones."""
    a, sizes_a, row = _marks(batch, "a_marks")
    b, sizes_b, _ = _marks(batch, "b_marks")
    from_a, from_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    links = sizes_a * sizes_b
    large = np.flatnonzero(links > PLAIN_LINKS)
    for g in large.tolist():
        ids_a, times_a = np.unique(a[from_a[g] : from_a[g] + sizes_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[from_b[g] : from_b[g] + sizes_b[g]], return_counts=True)
        step = max(1, LINKS_AT_ONCE // len(ids_b))
        for low in range(0, len(ids_a), step):
            pair = (ids_a[low : low + step, None] << 32 | ids_b).ravel()
            yield np.full(len(pair), row[g]), pair, np.outer(times_a[low : low + step], times_b).ravel()
    small = np.flatnonzero(links <= PLAIN_LINKS)
    upto = np.cumsum(links[small])
    for low in range(0, int(upto[-1]) if len(upto) else 0, LINKS_AT_ONCE):
        g = small[np.searchsorted(upto, low, "right") : np.searchsorted(upto, low + LINKS_AT_ONCE, "right")]
        # Most groups are of one token a side.
        alone, g = g[links[g] == 1], g[links[g] > 1]
        each = links[g]
        place = _within(each)
        wide = np.repeat(sizes_b[g], each)
        pair = a[np.repeat(from_a[g], each) + place // wide] << 32 | b[np.repeat(from_b[g], each) + place % wide]
        yield np.r_[row[alone], np.repeat(row[g], each)], np.r_[a[from_a[alone]] << 32 | b[from_b[alone]], pair], None


def _by_row(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_links``, each row's pairs once: rows of few marks together, longer ones alone."""
    places = byte_view(batch.column("a_marks"))[1] // 3
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(places, places[low] + MARKS_AT_ONCE, "right")) - 1)
        held = None
        for row, pair, times in _links(batch.slice(low, high - low)):
            row, pair, times = _summed(row, pair, times)
            if held is not None:
                row, pair, times = _summed(*(np.concatenate(x) for x in zip(held, (row, pair, times))))
            held = row, pair, times
        if held is not None:
            yield held[0] + low, held[1], held[2]
        low = high


# Bits of an id where row and pair are sorted as one number.
_ID_BITS = 18


def _summed(row, pair, times):
    """Distinct rows and pairs in order, with their sums; ``times`` of None are ones."""
    if times is None:
        low = (1 << _ID_BITS) - 1
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if len(row) and max(a.max(), b.max()) <= low and row.max() < 1 << 63 - 2 * _ID_BITS:
            key, times = _counted(row << 2 * _ID_BITS | a << _ID_BITS | b)
            return key >> 2 * _ID_BITS, (key >> _ID_BITS & low) << 32 | key & low, times
        times = np.ones(len(pair), np.int64)
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[edge], pair[edge], np.add.reduceat(times, edge) if len(edge) else times


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair, n, best`` from the second table of ``mark``: how many rows hold each pair of
    ids linked, and whether no pair of the same A id is in more.

    ``best`` compares with one number for each A id, a table no longer than A's vocabulary.
    """
    counts = saved(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a_id = F.shiftright("pair", 32).alias("a_id")
    most = counts.groupBy(a_id).agg(F.max("n").alias("most"))
    return counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    numbers = np.sort(numbers)
    edge = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
    return numbers[edge], np.diff(np.r_[edge, len(numbers)])


def _merged(held):
    pair, n = (np.concatenate(x) for x in zip(*held))
    _, pair, n = _summed(np.zeros(len(pair), np.int64), pair, n)
    return pair, n


def _head(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """The most frequent pairs, sorted, as many whole counts as ``limit`` holds, and the rest."""
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    # Distinct counts are few: they sum to at most the number of links.
    falling = Window.orderBy(F.desc("n"))
    first_out = by_count.withColumn("upto", F.sum("m").over(falling)).where(F.col("upto") > limit).agg(F.max("n")).first()[0]
    head = counts if first_out is None else counts.where(F.col("n") > first_out)
    table = head.toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    rest = counts.where(F.lit(False)) if first_out is None else counts.where(F.col("n") <= first_out)
    return pair[order], n[order], best[order], rest


def link_scores(marked: DataFrame, counts: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``row, n_links, n_best, count_sum`` of the first table of ``mark``; ``counts`` is a
    saved table of ``pair_counts``.

    The counts of the ``head_pairs`` most frequent pairs go to every task. A row's other
    pairs leave it as a list and are joined by a shuffle; rare pairs are no hot keys.
    """
    spark = marked.sparkSession
    pairs, n_docs, is_best, rest = _head(counts, head_pairs)
    shared = spark.sparkContext.broadcast((pairs, n_docs, is_best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            links, best_links, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            left: list[tuple[np.ndarray, ...]] = []
            for row, pair, times in _by_row(batch):
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                np.add.at(links, row, times)
                np.add.at(best_links, row[found], (times * best[at])[found] if len(known) else times[found])
                np.add.at(total, row[found], (times * count[at])[found] if len(known) else times[found])
                left.append((row[~found], pair[~found], times[~found]))
            row, pair, times = (np.concatenate(x) for x in zip(*left)) if left else (np.zeros(0, np.int64),) * 3
            places = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(places), pa.array(x)) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(links), pa.array(best_links), pa.array(total), *lists],
                names=["row", "n_links", "n_best", "count_sum", "pairs", "times"],
            )

    schema = "row bigint, n_links bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    columns = marked.select("row", "a_marks", "b_marks")
    first = saved(columns.mapInArrow(score, schema), "link-scores")
    rare = first.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rare = rare.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(rest, "pair")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
    )
    zero = F.lit(0).cast("long")
    return first.join(more, "row", "left").select(
        "row", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"),
    )


def report(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``doc_id`` and the alignment's numbers for every row: ``n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``.

    Rows without tokens have zeros and an empty digest. Repeated rows and rows without an id
    are rows of their own, and each counts among the rows that hold a pair.
    """
    rows, parts = mark(docs, byte_path, pattern, piece_path)
    scores = link_scores(rows, saved(pair_counts(parts), "counted-pairs"), head_pairs)
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(scores, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
