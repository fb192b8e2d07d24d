"""Documents that hold passages of a benchmark: a prefix-filtered containment join."""

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import annotate, byte_view, longs, per_text, text_slices
from lectern.llm.words import LETTERS_DIGITS, LOWER, hashed_words, sequence_hash, sequence_hashes
from lectern.plans.shared import saved

WINDOW = 10
# Benchmark text that one pass over the documents looks for; more makes further passes.
BLOCK_BYTES = 16 << 20


@dataclass
class Windows:
    """Distinct windows of benchmark items: hash, size, words, and the items of each."""

    hashes: np.ndarray
    sizes: np.ndarray
    words: list[np.ndarray]
    texts: list[bytes]
    items: list[list]
    prefix: np.ndarray = None
    offset: np.ndarray = None

    def by_rarity(self, counts: dict[int, int]) -> "Windows":
        """Choose each window's prefix: all its words are needed, so its rarest one will do.

        Ties go to the first such word of the window. Sorted by prefix for bisection.
        """
        offset = [int(np.argmin([counts.get(int(w), 0) for w in words])) for words in self.words]
        prefix = np.array([words[o] for words, o in zip(self.words, offset)], np.uint64)
        order = np.argsort(prefix, kind="stable")
        pick = lambda values: [values[i] for i in order]
        return Windows(
            self.hashes[order], self.sizes[order], pick(self.words), pick(self.texts), pick(self.items),
            prefix[order], np.array(offset, np.int64)[order],
        )


def windows_of(items: list[tuple], size: int = WINDOW) -> Windows:
    """Every ``size`` consecutive words of an item, or all of them if there are fewer."""
    found: dict[tuple, list] = {}
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        begin, end, hashes, _ = hashed_words(raw, np.array([0, len(raw)]), LETTERS_DIGITS)
        if not len(hashes):
            continue
        low = LOWER[raw].tobytes()
        spelled = [low[b:e] for b, e in zip(begin.tolist(), end.tolist())]
        for i in range(max(len(spelled) - size + 1, 1)):
            key = b" ".join(spelled[i : i + size])
            entry = found.setdefault(key, [hashes[i : i + size], set()])
            entry[1].add(item_id)
    words = [entry[0] for entry in found.values()]
    return Windows(
        np.array([sequence_hash(w) for w in words], np.uint64),
        np.array([len(w) for w in words], np.int64),
        words,
        list(found),
        [sorted(entry[1], key=lambda x: (x is not None, x)) for entry in found.values()],
    )


def corpus_counts(docs: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often each wanted word hash occurs in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for data, starts, _, _ in text_slices(batch.column(0)):
                _, _, words, _ = hashed_words(data, starts, LETTERS_DIGITS)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                total += np.bincount(at[known[at] == words], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(known[seen].view(np.int64)), longs(total[seen])], names=["word", "n"])

    if not len(wanted):
        return {}
    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(np.int64(r.word).astype(np.uint64)): r.n for r in rows.collect()}


def _occurrences(words: np.ndarray, first: np.ndarray, index: Windows):
    """Candidate ``window, first word`` pairs whose full word sequence has an equal hash."""
    last = np.searchsorted(index.prefix, words, "right")
    low = np.searchsorted(index.prefix, words, "left")
    place = np.flatnonzero(last > low)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(first, place, "right") - 1
    each = (last - low)[place]
    window = np.repeat(low[place] - np.cumsum(each) + each, each) + np.arange(each.sum())
    start = np.repeat(place, each) - index.offset[window]
    text = np.repeat(text, each)
    # Position and length: the window must lie within the text around the prefix word.
    fits = (start >= first[text]) & (start + index.sizes[window] <= first[text + 1])
    window, start, text = window[fits], start[fits], text[fits]
    same = np.zeros(len(window), bool)
    for size in np.unique(index.sizes[window]):
        mine = index.sizes[window] == size
        same[mine] = sequence_hashes(words, int(size))[start[mine]] == index.hashes[window[mine]]
    return window[same], start[same], text[same]


def _search(texts: pa.Array, index: Windows) -> dict[str, pa.Array]:
    n_words, ranges, items = [], [], []
    for data, starts, low, high in text_slices(texts):
        begin, end, words, first = hashed_words(data, starts, LETTERS_DIGITS)
        n_words.append(np.diff(first))
        window, start, text = _occurrences(words, first, index)
        spans, held = defaultdict(list), defaultdict(set)
        folded = LOWER[data].tobytes() if len(window) else b""
        b, e = begin.tolist(), end.tolist()
        for w, s, t in zip(window.tolist(), start.tolist(), text.tolist()):
            n = int(index.sizes[w])
            # Exact: the words themselves, not only their hashes.
            if b" ".join(folded[i:j] for i, j in zip(b[s : s + n], e[s : s + n])) == index.texts[w]:
                spans[t].append((s - int(first[t]), s - int(first[t]) + n))
                held[t].update(index.items[w])
        for t in range(high - low):
            ranges.append([{"first": x, "last": y} for x, y in _joined(spans.get(t, ()))])
            items.append(sorted(held.get(t, ())))
    return {
        "n_words": longs(np.concatenate(n_words) if n_words else []),
        "hits": pa.array(ranges, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        "items": pa.array(items, pa.list_(pa.int64())),
    }


def _joined(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


SCHEMA = "struct<n_words:bigint,hits:array<struct<first:bigint,last:bigint>>,items:array<bigint>>"


def find_items(docs: DataFrame, benchmark: DataFrame, name: str = "leak", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``name``: struct of ``n_words``, ``hits`` (word ranges covered by
    windows, last exclusive; ranges of several blocks may overlap) and ``items`` (ids).

    The benchmark (``item_id bigint, text``) is cut into blocks by item so that a block's
    texts stay below ``block_bytes``, about; documents are searched for one block after
    another, and between blocks the result so far is written. Null and empty texts and an
    empty benchmark give no hit; items without an id are left out, as they cannot be
    reported; an item repeated under its id counts once. Rows and other columns pass
    unchanged, an older column ``name`` is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = docs
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = windows_of([tuple(r) for r in mine.collect()], size)
        wanted = np.unique(np.concatenate(found.words)) if found.words else np.zeros(0, np.uint64)
        index = found.by_rarity(corpus_counts(docs, wanted))
        held = spark.sparkContext.broadcast(index)

        def start(held=held):
            learned = held.value
            return lambda texts: _search(texts, learned)

        search = per_text(start, SCHEMA)
        if block == 0:
            out = annotate(docs, name, search)
        else:
            more = annotate(saved(out, "leaks"), "_more", search)
            both = F.struct(
                F.col(f"{name}.n_words").alias("n_words"),
                F.concat(f"{name}.hits", "_more.hits").alias("hits"),
                F.array_distinct(F.concat(f"{name}.items", "_more.items")).alias("items"),
            )
            out = more.withColumn(name, both).drop("_more")
    return out


def digests(found: DataFrame, name: str = "leak") -> DataFrame:
    """Counts and digest of each document of ``find_items``."""
    hits = F.array_sort(F.col(f"{name}.hits"))
    # Words covered once, also where ranges of several blocks overlap.
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["last"] - F.greatest(x["first"], acc["upto"]), F.lit(0))).alias("n"),
            F.greatest(acc["upto"], x["last"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    ids = F.array_sort(F.col(f"{name}.items").cast("array<string>"))
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        covered.alias("n_hit"),
        F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size(f"{name}.hits") > 0).alias("contaminated"),
    )
