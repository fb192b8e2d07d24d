"""Near copies by SuperMinHash signatures, banding, verification and components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import longs, text_slices
from lectern.llm.components import components
from lectern.llm.vectors import add_up
from lectern.llm.words import NOT_SPACE, hashed_words, mix, salted, shingles, strengthened
from lectern.plans.shared import saved

U = np.uint64
SHINGLE = 5
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
# At a similarity of 0.75 a pair shares no band once in about 4 million.
BANDS, ROWS = 40, 4
# Elements whose permutations are held at once.
STEP_ELEMENTS = 1 << 16
# Counters, as a power of two, of the sketch that orders shingles by rarity.
SKETCH_BITS = 18
# Members of a bucket that are compared with its head in one task, about.
CHUNK = 256


def signatures(elements: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """SuperMinHash signatures of sets (``elements`` of ``text``), one row for each text.

    Step ``j`` gives each element a uniform rank in ``[j, j + 1)`` at the ``j``-th place of
    its own random permutation of the bins; a bin keeps its least rank. A text whose bins
    are all below ``j`` cannot change any more and stops early.
    """
    bins = np.full(n_texts * size, np.inf)
    for low in range(0, len(elements), STEP_ELEMENTS):
        order = np.arange(low, min(low + STEP_ELEMENTS, len(elements)))
        row = order - low
        places = np.broadcast_to(np.arange(size, dtype=np.uint16), (len(order), size)).copy()
        for j in range(size):
            full = bins.reshape(n_texts, size).max(1) < j
            stay = ~full[text[order]]
            order, row = order[stay], row[stay]
            if not len(order):
                break
            draw = salted(elements[order], j + 1)
            rank = j + (draw >> U(11)).astype(np.float64) / (1 << 53)
            k = (j + (mix(draw) >> U(33)) % U(size - j)).astype(np.int64)
            chosen = places[row, k].astype(np.int64)
            places[row, k] = places[row, j]
            np.minimum.at(bins, text[order] * size + chosen, rank)
    return bins.reshape(n_texts, size)


def _sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and the text of each, ordered by text."""
    begin, end, words, first = hashed_words(data, starts, NOT_SPACE)
    return shingles(strengthened(data, begin, end, words), first, SHINGLE)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for data, starts, low, high in text_slices(batch.column("text"), 1 << 19):
            n = high - low
            found, text = _sets(data, starts)
            size = np.bincount(text, minlength=n)
            key1, key2 = np.zeros(n, U), np.zeros(n, U)
            np.add.at(key1, text, salted(found, 101))
            np.add.at(key2, text, salted(found, 202))
            marks = signatures(found, text, n, BANDS * ROWS).view(U).reshape(n, BANDS, ROWS)
            bands = np.zeros((n, BANDS), U)
            for r in range(ROWS):
                bands = mix(bands + marks[:, :, r])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
            has = np.where(size > 0, BANDS, 0)
            places = np.zeros(n + 1, np.int32)
            np.cumsum(has, out=places[1:])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, n), longs(size), longs(key1.view(np.int64)), longs(key2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(places), longs(bands[size > 0].ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "key1", "key2", "bands"],
            )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, the head first; each member is compared with its head."""
    group, head = None, None
    for batch in batches:
        key = list(zip(batch.column("head").to_pylist(), batch.column("chunk").to_pylist()))
        ids = batch.column("doc_id").to_pylist()
        out = []
        for data, starts, low, high in text_slices(batch.column("text")):
            found, text = _sets(data, starts)
            edges = np.searchsorted(text, np.arange(high - low + 1))
            for i in range(low, high):
                mine = found[edges[i - low] : edges[i - low + 1]]
                if ids[i] == key[i][0]:
                    group, head = key[i], mine.copy()
                elif key[i] == group:
                    common = len(np.intersect1d(head, mine, assume_unique=True))
                    out.append((key[i][0], ids[i], common, len(head) + len(mine) - common))
        yield pa.RecordBatch.from_arrays(
            [longs([x[c] for x in out]) for c in range(4)], names=["a", "b", "common", "either"]
        )


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, common, either`` of pairs of ids: sizes of the sets' intersection and union.

    Texts move once by id and once, those of compared documents, to their group. A head
    with many partners is copied to one task for each ``CHUNK`` of them.
    """
    pairs = saved(pairs, "pairs")
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK))
    member = pairs.join(heads, "a").select(F.col("a").alias("head"), chunk.alias("chunk"), F.col("b").alias("doc_id"))
    needed = member.unionByName(member.select("head", "chunk", F.col("head").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(needed.hint("merge"), "doc_id").select(
        "head", "chunk", (F.col("doc_id") != F.col("head")).alias("later"), "doc_id", "text"
    )
    dealt = texts.repartition("head", "chunk").sortWithinPartitions("head", "chunk", "later", "doc_id")
    return dealt.select("head", "chunk", "doc_id", "text").mapInArrow(
        _verified, "a bigint, b bigint, common bigint, either bigint"
    )


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros(1 << SKETCH_BITS)
    for batch in batches:
        for data, starts, _, _ in text_slices(batch.column("text")):
            total += np.bincount(_slots(_sets(data, starts)[0]), minlength=len(total))
    yield pa.RecordBatch.from_arrays(
        [pa.array(["counts"]), longs([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
        names=["key", "part", "vector"],
    )


def _slots(elements: np.ndarray) -> np.ndarray:
    return (salted(elements, 303) >> U(64 - SKETCH_BITS)).astype(np.int64)


def _prefixes(counts, percent: int):
    """Rarest shingles of each text: two sets that are similar enough share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, low, high in text_slices(batch.column("text")):
                found, text = _sets(data, starts)
                order = np.lexsort((found, counts.value[_slots(found)], text))
                found, text = found[order], text[order]
                size = np.bincount(text, minlength=high - low)
                begin = np.cumsum(size) - size
                length = size - (size * percent + 99) // 100 + 1
                place = np.arange(len(found)) - begin[text]
                keep = place < length[text]
                mine = pa.array(text[keep] + low)
                yield pa.RecordBatch.from_arrays(
                    [longs(found[keep].view(np.int64)), batch.column("doc_id").take(mine), longs(size[text[keep]]), longs(place[keep]), batch.column("component").take(mine)],
                    names=["element", "doc_id", "size", "place", "component"],
                )

    return run


def remaining_pairs(texts: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of every two texts (``doc_id, text, component``) that could still be linked.

    A prefix filter in one order of all shingles, rarest first by a sketch of fixed size:
    the pairs are complete whatever the order, and passages that many texts share come
    last in it, so they bring no pairs about. The smaller set of a pair needs a shorter
    prefix; and at the first shared shingle of a linked pair, what follows in either set
    still has to make up the intersection.
    """
    counts = add_up(texts.mapInArrow(_sketched, "key string, part bigint, vector binary")).first()
    total = np.frombuffer(counts.vector) if counts else np.zeros(1 << SKETCH_BITS)
    held = texts.sparkSession.sparkContext.broadcast(total)
    schema = "element bigint, doc_id bigint, size bigint, place bigint, component bigint"
    prefixes = saved(texts.mapInArrow(_prefixes(held, percent), schema), "prefixes")
    mixed = prefixes.groupBy("element").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = prefixes.join(mixed.where("x < y").select("element"), "element")
    needed = F.ceil(F.col("size") * (2 * percent) / F.lit(100 + percent))
    p, q = mixed.where(F.col("place") <= F.col("size") - needed).alias("p"), mixed.alias("q")
    smaller = F.struct("p.size", "p.doc_id") < F.struct("q.size", "q.doc_id")
    fits = F.col("p.size") * 100 >= F.col("q.size") * percent
    rest = F.least(F.col("p.size") - F.col("p.place"), F.col("q.size") - F.col("q.place"))
    reach = rest * (100 + percent) >= (F.col("p.size") + F.col("q.size")) * percent
    other = F.col("p.component") != F.col("q.component")
    return p.join(q, (F.col("p.element") == F.col("q.element")) & smaller & other & fits & reach).select(
        F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")
    ).distinct()


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id bigint, text``.

    Sets are the distinct five-word shingles of the lower-cased whole text, the whole
    sequence if there are fewer words; equal sets form a class that its least id stands
    for. Class heads that share a band are candidates. The head of each bucket is compared
    with every member first, so a group of copies costs one comparison a member. Members
    of one bucket that this leaves in different components are compared by an exact
    prefix filter, so no candidate is given up and none is made of a shared passage alone.
    Null, empty and blank texts have no shingle and are linked with nothing. Rows repeated
    under an id share its links; a row without an id has no component and is not kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(
        docs.mapInArrow(_signed, "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, bands array<bigint>"),
        "signed",
    )
    same = ["key1", "key2", "n_shingles"]
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(named.groupBy(*same).agg(F.min(F.struct("doc_id", "bands")).alias("one")).select(
        *same, "one.doc_id", "one.bands"), "classes")
    marks = classes.select("doc_id", F.explode("bands").alias("band"))
    heads = marks.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    buckets = saved(marks.join(heads.select("band", "a").hint("merge"), "band"), "buckets")
    # The texts of candidates: the whole corpus moves once, by id.
    some = buckets.select("doc_id").distinct()
    texts = saved(docs.join(some.hint("merge"), "doc_id", "left_semi"), "candidates")
    linked = F.col("common") * 100 >= F.col("either") * percent
    stars = verify(texts, buckets.where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct())
    links = saved(stars.where(linked).select("a", "b"), "links")
    found = saved(components(links), "component")

    member = F.coalesce("component", "doc_id").alias("component")
    apart = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", member)
    mixed = apart.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    left = apart.join(mixed.select("band"), "band").select("doc_id", "component").distinct()
    left = saved(texts.join(left.hint("merge"), "doc_id"), "apart")
    more = saved(verify(left, remaining_pairs(left, percent)).where(linked).select("a", "b"), "links")
    if not more.isEmpty():
        found = saved(components(links.unionByName(more)), "component")
    class_of = classes.select(*same, F.col("doc_id").alias("node")).join(found, "node", "left").select(
        *same, F.coalesce("component", "node").alias("component")
    )
    return signed.join(class_of, same, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
