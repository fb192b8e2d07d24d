"""Masked pseudo-likelihood of texts: every word predicted from the words on both sides."""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import annotate, longs, per_text, text_slices
from lectern.llm.vectors import add_up
from lectern.llm.words import NOT_SPACE, hashed_words
from lectern.plans.shared import BROADCAST_BYTES, most_frequent, saved

U = np.uint64
# Output words, in classes of equal size: the most frequent words have a place of their
# own, the others share hashed places. A word's probability is that of its place times its
# share of the place, which the counts of all words give.
CLASSES, IN_CLASS = 64, 64
VOCABULARY = CLASSES * IN_CLASS
SHARED = 1024
PAD = VOCABULARY
OFFSETS = (-2, -1, 1, 2)
EMBED, HIDDEN = 8, 24
BATCH = 4096
# Each document is trained on once, in the round that its id's hash names.
ROUNDS = 2


@dataclass(frozen=True)
class Network:
    """Window network: embeddings, one hidden layer, classes, words within each class.

    ``counts`` is the saved table of all words, which grows with the documents and stays
    off the driver; ``slots`` has occurrences and distinct words of each shared place.
    """

    words: np.ndarray
    places: np.ndarray
    embed: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray
    slots: np.ndarray | None = None
    counts: DataFrame | None = None

    PARTS = ("embed", "inner", "inner_bias", "to_class", "class_bias", "to_word", "word_bias")

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS]).astype(np.float64)

    def with_vector(self, flat: np.ndarray) -> "Network":
        new, at = {}, 0
        for part in self.PARTS:
            old = getattr(self, part)
            new[part] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return replace(self, **new)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        shared = VOCABULARY - SHARED + (hashes >> U(40)) % U(SHARED)
        if not len(self.words):
            return shared.astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.places[at], shared.astype(np.int64))

    def without_counts(self) -> "Network":
        """What tasks are sent."""
        return replace(self, counts=None)

    def log_shares(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log share that words seen ``n`` times have of their places; 0 of their own.

        One is added to every count, so that all unseen words of a place have one share.
        """
        out = np.zeros(len(ids))
        if self.slots is not None:
            shared = ids >= VOCABULARY - SHARED
            total, distinct = self.slots[ids[shared] - (VOCABULARY - SHARED)].T
            out[shared] = np.log((n[shared] + 1) / (total + distinct + 1))
        return out


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ids around each word; a place outside its text is padding."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = first[:-1][text], first[1:][text]
    out = np.full((len(ids), len(OFFSETS)), PAD, np.int64)
    here = np.arange(len(ids))
    for k, offset in enumerate(OFFSETS):
        at = here + offset
        inside = (at >= low) & (at < high)
        out[inside, k] = ids[at[inside]]
    return out


# Logits up to this size neither overflow nor vanish as exponentials of 32-bit numbers.
SAFE_LOGIT = 60.0


def _exp(z: np.ndarray, bound: float) -> np.ndarray:
    """Exponentials in place, up to a factor for each row, of logits no larger than ``bound``."""
    if bound > SAFE_LOGIT:
        z -= z.max(1, keepdims=True)
    return np.exp(z, out=z)


def _log_softmax_at(z: np.ndarray, at: np.ndarray, bound: float, ones: np.ndarray) -> np.ndarray:
    """Log softmax of one entry of each row; ``z`` is overwritten."""
    if bound > SAFE_LOGIT:
        z -= z.max(1, keepdims=True)
    picked = z[np.arange(len(z)), at]
    return picked - np.log(np.exp(z, out=z) @ ones)


def _with_bias(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Both output layers with their biases as a last row."""
    to_class = np.vstack([net.to_class, net.class_bias])
    return to_class, np.concatenate([net.to_word, net.word_bias[:, None]], 1)


def _bound(layer: np.ndarray) -> float:
    """The largest size a logit can have, as hidden units lie between -1 and 1."""
    return float(np.abs(layer).sum(-2).max())


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order that sorts words by class, their classes, and ``class, first, end`` of each run."""
    group = (ids // IN_CLASS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    group = group[order]
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return order, group, list(zip(group[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(group)]))


def _hidden(net: Network, given: np.ndarray) -> np.ndarray:
    """Hidden units and a last column of ones, which the biases go with."""
    out = np.ones((len(given), HIDDEN + 1), np.float32)
    np.tanh(given @ net.inner + net.inner_bias, out=out[:, :HIDDEN])
    return out


def _given(net: Network, around: np.ndarray) -> np.ndarray:
    return net.embed.take(around.ravel(), 0).reshape(len(around), -1)


def log_probabilities(net: Network, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Conditional log probability of each word given its window."""
    out = np.empty(len(ids))
    to_class, to_word = _with_bias(net)
    bounds = _bound(to_class), _bound(to_word)
    ones, logits = np.ones(IN_CLASS, np.float32), np.empty((min(BATCH, len(ids)), IN_CLASS), np.float32)
    for low in range(0, len(ids), BATCH):
        y = ids[low : low + BATCH]
        order, group, runs = _by_class(y)
        place = y[order] % IN_CLASS
        hidden = _hidden(net, _given(net, around[low : low + BATCH][order]))
        words = logits[: len(y)]
        for c, a, b in runs:
            np.matmul(hidden[a:b], to_word[c], out=words[a:b])
        out[low + order] = _log_softmax_at(words, place, bounds[1], ones) + _log_softmax_at(
            hidden @ to_class, group, bounds[0], ones
        )
    return out


def train(net: Network, around: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One pass of stochastic gradient ascent over the words, in place."""
    to_class, to_word = _with_bias(net)
    ones, logits = np.ones(IN_CLASS, np.float32), np.empty((min(BATCH, len(ids)), IN_CLASS), np.float32)
    for low in range(0, len(ids), BATCH):
        y = ids[low : low + BATCH]
        order, group, runs = _by_class(y)
        window = around[low : low + BATCH][order]
        n, here, place = len(y), np.arange(len(y)), y[order] % IN_CLASS
        given = _given(net, window)
        hidden = _hidden(net, given)
        step = np.float32(rate / n)
        miss = _exp(hidden @ to_class, _bound(to_class))
        miss *= (-1 / (miss @ ones))[:, None]
        miss[here, group] += 1
        off = logits[:n]
        for c, a, b in runs:
            np.matmul(hidden[a:b], to_word[c], out=off[a:b])
        _exp(off, _bound(to_word))
        off *= (-1 / (off @ ones))[:, None]
        off[here, place] += 1
        back = miss @ to_class.T
        for c, a, b in runs:
            back[a:b] += off[a:b] @ to_word[c].T
            to_word[c] += step * (hidden[a:b].T @ off[a:b])
        to_class += step * (hidden.T @ miss)
        back, units = back[:, :HIDDEN], hidden[:, :HIDDEN]
        back *= 1 - units**2
        to_given = back @ net.inner.T
        net.inner[:] += step * (given.T @ back)
        net.inner_bias[:] += step * back.sum(0)
        flat = window.ravel()
        to_given = to_given.reshape(-1, EMBED)
        for d in range(EMBED):
            net.embed[:, d] += (step * EMBED) * np.bincount(flat, to_given[:, d], len(net.embed)).astype(np.float32)
    net.to_class[:], net.class_bias[:] = to_class[:-1], to_class[-1]
    net.to_word[:], net.word_bias[:] = to_word[:, :-1], to_word[:, -1]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` of every word of all documents, summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def reduced():
            words = np.concatenate([w for w, _ in held])
            found, place = np.unique(words, return_inverse=True)
            return found, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(words, n):
            for low in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [longs(words[low : low + 100_000].view(np.int64)), longs(n[low : low + 100_000])], names=["word", "n"]
                )

        for batch in batches:
            for data, starts, _, _ in text_slices(batch.column(0)):
                words = hashed_words(data, starts, NOT_SPACE)[2]
                held.append(np.unique(words, return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held = [reduced()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*reduced())

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def start_network(counts: DataFrame, seed: int = 3) -> Network:
    """Untrained network whose biases give the words' frequencies in all documents.

    ``counts`` is a saved table of all words; the driver gets the listed ones alone.
    """
    own = VOCABULARY - SHARED
    listed = most_frequent(counts.withColumnRenamed("word", "token"), own, "listed-words")
    listed = listed.orderBy(F.desc("n"), "token").withColumnRenamed("token", "word").collect()
    bucket = F.shiftrightunsigned("word", 40) % SHARED
    shared = counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    slots = np.zeros((SHARED, 2))
    for r in shared:
        slots[r.b] = r.n, r.m
    words = np.array([r.word for r in listed], np.int64).view(U)
    n = np.ones(VOCABULARY)
    n[: len(listed)] += [r.n for r in listed]
    for r in listed:
        slots[(int(r.word) % (1 << 64) >> 40) % SHARED] -= r.n, 1
    n[own:] += slots[:, 0]
    table = np.maximum(n, 1).reshape(CLASSES, IN_CLASS)
    order = np.argsort(words)
    rng = np.random.default_rng(seed)
    random = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    return Network(
        words[order],
        order.astype(np.int64),
        (rng.normal(size=(VOCABULARY + 1, EMBED)) * 0.3).astype(np.float32),
        random(len(OFFSETS) * EMBED, HIDDEN),
        np.zeros(HIDDEN, np.float32),
        np.zeros((HIDDEN, CLASSES), np.float32),
        np.log(table.sum(1) / table.sum()).astype(np.float32),
        np.zeros((CLASSES, HIDDEN, IN_CLASS), np.float32),
        np.log(table / table.sum(1, keepdims=True)).astype(np.float32),
        slots,
        counts,
    )


def _windows(texts, net):
    for data, starts, low, high in text_slices(texts):
        _, _, hashes, first = hashed_words(data, starts, NOT_SPACE)
        ids = net.ids(hashes)
        yield ids, first, contexts(ids, first), hashes


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = 2.0) -> Network:
    """Train on every word of every document.

    Tasks train copies of the network on their own rows; the copies are averaged by the
    number of words seen, on the executors, and the next round goes on from the mean. The
    network's size is fixed, so the driver only ever holds one sum; the counts of all words
    are a table that the network refers to. Rows without text
    teach nothing. The layout of the rows has a small influence on the weights.
    """
    docs = docs.select("doc_id", "text")
    net = start_network(saved(word_counts(docs), "word-counts"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for number in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(net.without_counts())

        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            mine = held.value.with_vector(held.value.vector())
            seen = 0
            for batch in batches:
                for ids, _, around, _ in _windows(batch.column(0), mine):
                    train(mine, around, ids, rate)
                    seen += len(ids)
            if seen:
                raw = np.append(mine.vector() * seen, seen).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["network"]), pa.array([TaskContext.get().partitionId()]), pa.array([raw], pa.binary())],
                    names=["key", "part", "vector"],
                )

        mine = docs.where(F.coalesce(part, F.lit(0)) == number).select("text")
        found = add_up(mine.mapInArrow(learn, "key string, part bigint, vector binary")).collect()
        if found:
            total = np.frombuffer(found[0].vector, np.float64)
            net = net.with_vector(total[:-1] / total[-1])
    return net


def score(docs: DataFrame, net: Network, name: str = "lm", held_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``name``: struct of ``n_tokens``, ``log_prob`` (the sum of conditional
    log probabilities) and ``mean_log_prob``.

    A word without a place of its own has its share of the shared place. The counts of the
    most frequent words, as many as ``held_bytes`` hold, are broadcast; the rarer words of
    the documents are joined with the table of counts by a shuffle. Null and empty texts
    have no words, a sum of 0 and a null mean. Whole texts are read; rows and other columns
    pass unchanged, an older column ``name`` is replaced.
    """
    spark = docs.sparkSession
    words, n, whole = np.zeros(0, U), np.zeros(0), True
    if net.counts is not None:
        size = max(held_bytes // 16, VOCABULARY - SHARED)
        whole = net.counts.count() <= size
        listed = net.counts if whole else most_frequent(net.counts.withColumnRenamed("word", "token"), size, "held-words")
        table = listed.toDF("word", "n").toArrow()
        words, n = (table.column(c).to_numpy() for c in ("word", "n"))
        order = np.argsort(words.view(U))
        words, n = words.view(U)[order], n[order].astype(np.float64)
    held = spark.sparkContext.broadcast((net.without_counts(), words, n))

    def start():
        learned, words, counts = held.value

        def work(texts):
            n, total, rest, rests = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ids, first, around, hashes in _windows(texts, learned):
                logp = log_probabilities(learned, around, ids)
                rare = np.flatnonzero(ids >= VOCABULARY - SHARED)
                seen, known = _counts_of(hashes[rare], words, counts)
                use = known | whole
                logp[rare[use]] += learned.log_shares(ids[rare[use]], seen[use])
                size = np.diff(first)
                text = np.repeat(np.arange(len(size)), size)
                n.append(size)
                total.append(np.bincount(text, logp, len(size)))
                rest.append(hashes[rare[~use]].view(np.int64))
                rests.append(np.bincount(text[rare[~use]], minlength=len(size)))
            n, total = np.concatenate(n), np.concatenate(total)
            places = np.r_[0, np.cumsum(np.concatenate(rests))].astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(places), longs(np.concatenate(rest)))
            return {"n_tokens": longs(n), "log_prob": pa.array(total), "tail": tail}

        return work

    run = per_text(start, "struct<n_tokens:bigint,log_prob:double,tail:array<bigint>>")
    result = lambda n, total: F.struct(
        n.alias("n_tokens"), total.alias("log_prob"), F.when(n > 0, total / n).alias("mean_log_prob")
    )
    if whole:
        found = annotate(docs, name, run)
        return found.withColumn(name, result(F.col(f"{name}.n_tokens"), F.col(f"{name}.log_prob")))
    key, digest, part = "lm__id", "lm__digest", "lm__scored"
    # Rows of one id and text have one score.
    texts = docs.select(F.col("doc_id").alias(key), F.xxhash64("text").alias(digest), "text")
    scored = annotate(texts, part, run).select(key, digest, f"{part}.*").dropDuplicates([key, digest])
    scored = saved(scored, "scored")
    slot = F.shiftrightunsigned("word", 40) % SHARED
    slots = spark.createDataFrame([(b, float(t + m)) for b, (t, m) in enumerate(net.slots.tolist())], "slot bigint, size double")
    share = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("size") + 1))
    tail = scored.select(key, digest, F.explode("tail").alias("word")).groupBy(key, digest, "word").agg(F.count(F.lit(1)).alias("times"))
    shares = tail.join(net.counts, "word", "left").withColumn("slot", slot).join(F.broadcast(slots), "slot")
    sums = shares.groupBy(key, digest).agg(F.sum(F.col("times") * share).alias("more"))
    a, b = scored.drop("tail"), sums.toDF("more__id", "more__digest", "more")
    both = a.join(b, a[key].eqNullSafe(b["more__id"]) & (a[digest] == b["more__digest"]), "left")
    both = both.select(
        F.col(key).alias("of__id"), F.col(digest).alias("of__digest"),
        result(F.col("n_tokens"), F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias(part),
    )
    rows = docs.withColumn(digest, F.xxhash64("text"))
    rows = rows.join(both, rows["doc_id"].eqNullSafe(both["of__id"]) & (rows[digest] == both["of__digest"]), "left")
    return rows.withColumn(name, F.col(part)).drop(digest, part, "of__id", "of__digest")


def _counts_of(hashes, words, counts):
    """Counts of words from a sorted list, and whether they are in it."""
    if not len(words):
        return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    known = words[at] == hashes
    return np.where(known, counts[at], 0.0), known
