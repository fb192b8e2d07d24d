"""Removal of byte strings that occur before, by sorting one bucket of suffixes at a time.

Only the first ``SIZE`` bytes of a suffix matter. Suffixes are dealt into buckets by the
least hash among their 8-byte substrings, rare ones first, so equal ones meet and
neighbours travel together: a bucket receives short runs of text instead of one record for each position.
A bucket is sorted by hashes of its suffixes' first bytes; ties are resolved by ranks of a
difference-cover sample of its positions, never by comparing long strings.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import longs, text_slices
from lectern.llm.vectors import add_up
from lectern.llm.words import mix, prefix_sums, span_hashes
from lectern.plans.shared import saved

U = np.uint64
SIZE = 100
GRAM = 8
# Counters of substrings, as a power of two; one is hot beyond this multiple of the mean.
GRAM_BITS, HOT = 18, 8
# Text of one bucket, about; its runs are some three times as long.
BUCKET_BYTES = 1 << 20
# Runs that a task gathers before it hands them on, in bytes.
HELD_BYTES = 24 << 20
# A longer text is worked on in pieces that overlap by ``SIZE - 1`` bytes.
PIECE = 1 << 20
# Difference cover: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 7, (0, 1, 3)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
# By the places' remainders: the least shift at which both meet the sample.
_SHIFT = np.array([
    [next(s for s in range(PERIOD) if _IN_COVER[(a + s) % PERIOD] and _IN_COVER[(b + s) % PERIOD]) for b in range(PERIOD)]
    for a in range(PERIOD)
])
# Windows that are hashed at once.
STEP = 1 << 18

_BYTE = (np.arange(256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    x = data.astype(U)
    x = x[:-1] << U(8) | x[1:]
    x = x[:-2] << U(16) | x[2:]
    return x[:-4] << U(32) | x[4:]


def least_hashes(data: np.ndarray, size: int, hot: np.ndarray) -> np.ndarray:
    """For each window of ``size`` bytes the least hash of its 8-byte substrings; frequent
    substrings come after all others."""
    least, width, wanted = mix(grams(data)), 1, size - GRAM + 1
    least = least >> U(1) | hot[least >> U(64 - GRAM_BITS)].astype(U) << U(63)
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Which of the hash slots of 8-byte substrings hold far more of all texts than others.

    A line that a large share of the documents have fills slots by itself; suffixes that
    meet it are then dealt by what surrounds it, instead of into a few large buckets. The
    counters are of fixed size, and added up on the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << GRAM_BITS)
        for batch in batches:
            for data, _, _, _ in text_slices(batch.column("text"), PIECE):
                for low in range(0, max(len(data) - GRAM + 1, 0), PIECE):
                    slots = mix(grams(data[low : low + PIECE + GRAM - 1])) >> U(64 - GRAM_BITS)
                    total += np.bincount(slots.astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(["grams"]), longs([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
            names=["key", "part", "vector"],
        )

    found = add_up(docs.select("text").mapInArrow(count, "key string, part bigint, vector binary")).first()
    total = np.frombuffer(found.vector) if found else np.zeros(1 << GRAM_BITS)
    return total > HOT * max(total.mean(), 1)


def runs_of(data: np.ndarray, starts: np.ndarray, size: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """``first window, number of windows, least hash`` of maximal runs with one least hash."""
    if len(data) < size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U)
    least = least_hashes(data, size, hot)
    inside = np.ones(len(least), bool)
    # Windows that would cross the end of a text.
    marks = np.zeros(len(least) + 1, np.int64)
    np.add.at(marks, np.clip(starts[1:] - size + 1, starts[:-1], len(least)), 1)
    np.add.at(marks, np.minimum(starts[1:], len(least)), -1)
    inside = np.cumsum(marks)[:-1] == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    edge = starts[:-1][starts[:-1] < len(least)]
    opens[edge] = inside[edge]
    first = np.flatnonzero(opens)
    closes = np.flatnonzero(~inside)
    stop = np.r_[first[1:], len(least)]
    if len(closes):
        at = np.searchsorted(closes, first)
        stop = np.minimum(stop, np.r_[closes, len(least)][at])
    return first, stop - first, least[first]


def _gathered(size: int, buckets: int, hot):
    """Texts to ``bucket, doc, start, windows, known, body`` rows (columns packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, frequent = [], 0, hot.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for data, starts, low, high in text_slices(batch.column("text"), PIECE):
                if len(data) < size:
                    continue
                for base in range(0, len(data), PIECE):
                    # Only a slice of one long text has more than one piece.
                    piece = data[base : base + PIECE + size - 1]
                    edges = starts if len(starts) > 2 else np.array([0, len(piece)])
                    first, count, least = runs_of(piece, edges, size, frequent)
                    text = np.searchsorted(edges, first, "right") - 1
                    sums = prefix_sums(_BYTE[piece])
                    code = mix(span_hashes(sums, first, first + count + size - 1) + count.astype(U))
                    raw = piece.tobytes()
                    body = [raw[a:b] for a, b in zip(first.tolist(), (first + count + size - 1).tolist())]
                    bucket = (mix(least + U(1)) % U(buckets)).astype(np.int64)
                    held.append((bucket, ids[low:high][text], first - edges[text] + base, count, code, body))
                    weight += int(count.sum()) + (size - 1) * len(count)
                if weight > HELD_BYTES:
                    yield _packed(held)
                    held, weight = [], 0
        if held:
            yield _packed(held)

    return run


def _packed(held) -> pa.RecordBatch:
    """One row for each bucket. Of equal runs only the first one's text is sent; the
    others are known to be later already."""
    bucket, doc, start, count, code = (np.concatenate([h[k] for h in held]) for k in range(5))
    body = [b for h in held for b in h[5]]
    order = np.lexsort((start, doc, code, bucket))
    bucket, doc, start, count, code = (x[order] for x in (bucket, doc, start, count, code))
    body = [body[i] for i in order.tolist()]
    known = np.zeros(len(doc), np.uint8)
    keep = np.ones(len(doc), bool)
    head = 0
    like = np.flatnonzero(np.r_[False, (code[1:] == code[:-1]) & (bucket[1:] == bucket[:-1])])
    previous = -1
    for i in like.tolist():
        if i - 1 != previous:
            head = i - 1
        previous = i
        if body[i] == body[head]:
            # The same place of a row given twice is no repetition.
            if (doc[i], start[i]) == (doc[i - 1], start[i - 1]):
                keep[i] = False
                known[i] = known[i - 1]
            else:
                known[i] = 1
    chosen = np.flatnonzero(keep)
    edge = np.flatnonzero(np.r_[True, bucket[chosen][1:] != bucket[chosen][:-1]]) if len(chosen) else chosen
    pack = zstandard.ZstdCompressor(level=3).compress
    rows = []
    for low, high in zip(edge, np.r_[edge[1:], len(chosen)]) if len(chosen) else ():
        mine = chosen[low:high]
        text = b"".join([body[i] for i in mine.tolist() if not known[i]])
        rows.append((
            int(bucket[mine[0]]),
            pack(doc[mine].astype(np.int64).tobytes()),
            pack(start[mine].astype(np.int64).tobytes()),
            pack(count[mine].astype(np.int32).tobytes()),
            pack(known[mine].tobytes()),
            pack(text),
        ))
    names = ["bucket", "doc", "start", "count", "known", "body"]
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)


def window_hashes(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes of each window; ``at`` is increasing."""
    out = np.empty(len(at), U)
    for low in range(0, len(at), STEP):
        mine = at[low : low + STEP]
        first = mine[0]
        sums = prefix_sums(_BYTE[body[first : mine[-1] + length]])
        out[low : low + STEP] = mix(span_hashes(sums, mine - first, mine - first + length))
    return out


def later_windows(body: np.ndarray, at: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Which windows (increasing places ``at`` in ``body``) equal one of a lower ``order``."""
    flagged = np.zeros(len(at), bool)
    if len(at) < 2:
        return flagged
    # Equal windows have equal hashes; those with a hash of their own are done.
    key = window_hashes(body, at, size)
    which = _shared(key)
    key = key[which]
    by = np.argsort(key)
    key = key[by]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[edge, len(by)])
    which = which[by[np.repeat(sizes > 1, sizes)]]
    sizes = sizes[sizes > 1]
    if not len(which):
        return flagged
    place, rank_of = at[which], order[which]
    edge = np.cumsum(sizes) - sizes
    least = np.repeat(np.minimum.reduceat(rank_of, edge), sizes)
    group = np.repeat(np.arange(len(edge)), sizes)
    first = np.empty(len(edge), np.int64)
    lowest = np.flatnonzero(rank_of == least)
    first[group[lowest]] = lowest
    head = grams(np.r_[body, np.zeros(size + GRAM, np.uint8)])
    ranks = cover_ranks(head, place, size)
    # Any two places have a shift at which both meet the sample; the ranks of the windows
    # and of their group's first one there, and the bytes at both ends, decide.
    mine, other = place, place[first[group]]
    shift = _SHIFT[mine % PERIOD, other % PERIOD]
    same = (
        (ranks[mine + shift] == ranks[other + shift])
        & (head[mine] == head[other])
        & (head[mine + size - GRAM] == head[other + size - GRAM])
    )
    late = same & (rank_of > least)
    # A hash that different windows share: these groups are compared with each other.
    odd = np.zeros(len(edge), bool)
    odd[group[~same]] = True
    mixed = np.flatnonzero(odd[group])
    if len(mixed):
        late[mixed] = _later_by_shifts(head, place[mixed], rank_of[mixed], ranks, size)
    flagged[which[late]] = True
    return flagged


def _shared(keys: np.ndarray) -> np.ndarray:
    """Places of all keys that occur more than once, and of few others."""
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(0, np.int64)
    bits = max(10, len(again).bit_length() + 3)
    known = np.zeros(1 << bits, bool)
    known[again >> U(64 - bits)] = True
    return np.flatnonzero(known[keys >> U(64 - bits)])


def _later_by_shifts(head: np.ndarray, place: np.ndarray, rank_of: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    ends = head[place] ^ mix(head[place + size - GRAM])
    late = np.zeros(len(place), bool)
    for shift in range(PERIOD):
        # Two equal windows have some shift at which both meet the sample.
        mine = np.flatnonzero(_IN_COVER[(place + shift) % PERIOD])
        if not len(mine):
            continue
        key = mix(ends[mine] + mix(ranks[place[mine] + shift].astype(U) + U(1)))
        by = np.argsort(key)
        key, numbers = key[by], rank_of[mine[by]]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(numbers, edge), np.diff(np.r_[edge, len(by)]))
        late[mine[by]] |= numbers > least
    return late


def cover_ranks(head: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the sample positions within the given windows, for the ``size - PERIOD + 1``
    bytes from each: equal ranks mean equal strings. ``head`` has the 8 bytes from each
    position, up to ``size`` beyond the last window. Strides are multiples of the period,
    so a doubled rank again starts at a sample position."""
    marks = np.zeros(len(head) + 1, np.int32)
    # Places differ, so none is marked twice.
    marks[place] += 1
    marks[place + size] -= 1
    inside = np.cumsum(marks)[:-1] > 0
    sample = np.flatnonzero(inside)
    sample = sample[_IN_COVER[sample % PERIOD]]
    ranks = np.zeros(len(head) + size, np.int64)
    length = 2 * PERIOD
    ranks[sample] = _dense(mix(head[sample]) + head[sample + length - GRAM])
    wanted = size - PERIOD + 1
    while length < wanted:
        step = min(length, (wanted - length) // PERIOD * PERIOD)
        if step == 0:
            break
        ranks[sample] = _dense((ranks[sample] << 32 | ranks[sample + step]).view(U))
        length += step
    if length < wanted:
        ranks[sample] = _dense(mix(ranks[sample].astype(U) + U(1)) + head[sample + wanted - GRAM])
    return ranks


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _sorted_bucket(rows: list[tuple], size: int) -> pa.RecordBatch:
    unpack = zstandard.ZstdDecompressor().decompress
    doc = np.concatenate([np.frombuffer(unpack(r[0]), np.int64) for r in rows])
    start = np.concatenate([np.frombuffer(unpack(r[1]), np.int64) for r in rows])
    count = np.concatenate([np.frombuffer(unpack(r[2]), np.int32) for r in rows]).astype(np.int64)
    known = np.concatenate([np.frombuffer(unpack(r[3]), np.uint8) for r in rows]) > 0
    body = np.frombuffer(b"".join([unpack(r[4]) for r in rows]), np.uint8)
    d, s, n = doc[~known], start[~known], count[~known]
    out_doc, out_start, out_count = [doc[known]], [start[known]], [count[known]]
    if len(d):
        begin = np.cumsum(n + size - 1) - (n + size - 1)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + within
        by = np.lexsort((s, d))
        # Windows in the order of their documents; a place given twice has one number.
        new = np.r_[True, (d[by][1:] != d[by][:-1]) | (s[by][1:] != s[by][:-1])]
        first = np.maximum.accumulate(np.where(new, np.cumsum(n[by]) - n[by], 0))
        number = np.empty(len(d), np.int64)
        number[by] = first
        late = later_windows(body, at, np.repeat(number, n) + within, size)
        run = np.repeat(np.arange(len(d)), n)
        opens = np.flatnonzero(late & np.r_[True, ~late[:-1] | (run[1:] != run[:-1])])
        closes = np.flatnonzero(late & np.r_[~late[1:] | (run[1:] != run[:-1]), True])
        out_doc.append(d[run[opens]])
        out_start.append(s[run[opens]] + within[opens])
        out_count.append(closes - opens + 1)
    columns = [longs(np.concatenate(x)) for x in (out_doc, out_start, out_count)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "windows"])


def _bucketwise(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("doc", "start", "count", "known", "body")]
            for i, key in enumerate(batch.column("bucket").to_pylist()):
                if key != bucket and rows:
                    yield _sorted_bucket(rows, size)
                    rows = []
                bucket = key
                rows.append(tuple(c[i].as_py() for c in columns))
        if rows:
            yield _sorted_bucket(rows, size)

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for text, starts, counts in zip(batch.column("text"), batch.column("starts"), batch.column("counts")):
                raw = (text.as_py() or "").encode()
                low = np.asarray(starts.as_py() or [], np.int64)
                high = low + np.asarray(counts.as_py() or [], np.int64) + size - 1
                by = np.argsort(low, kind="stable")
                low, high = low[by], np.minimum(np.maximum.accumulate(high[by]), len(raw)) if len(by) else high
                new = np.r_[True, low[1:] > high[:-1]] if len(low) else np.zeros(0, bool)
                edge = np.flatnonzero(new)
                a = low[edge].tolist()
                b = high[np.r_[edge[1:], len(low)] - 1].tolist() if len(low) else []
                n_bytes.append(len(raw))
                n_removed.append(sum(b) - sum(a))
                spans.append([{"first": x, "last": y} for x, y in zip(a, b)])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), longs(n_bytes), longs(n_removed),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row of ``doc_id bigint, text``.

    A byte is removed if a ``size``-byte string over it also starts earlier: in a smaller
    ``doc_id`` or further ahead in the same text. ``spans`` are the maximal removed runs
    (``first``, ``last`` exclusive), ``kept`` the other bytes. Strings are judged on the
    whole input and never cross texts. Null and empty texts, and those shorter than
    ``size``, lose nothing. A row repeated under its id is one document; a row without an
    id loses nothing and is nobody's earlier text. ``size`` must be 40 or more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    packed = "bucket bigint, doc binary, start binary, count binary, known binary, body binary"
    hot = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs))
    dealt = docs.where("doc_id IS NOT NULL").mapInArrow(_gathered(size, buckets, hot), packed)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    runs = saved(dealt.mapInArrow(_bucketwise(size), "doc_id bigint, start bigint, windows bigint"), "repeats")
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    joined = docs.join(by_doc, "doc_id", "left").select(
        "doc_id", "text", F.col("found.start").alias("starts"), F.col("found.windows").alias("counts")
    )
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, kept binary"
    return joined.mapInArrow(_cut(size), schema)
