"""Prefix trie of conversations: z-fast tries of parts of them, merged by prefix digest.

A task inserts its sequences into a compacted trie, in batches. A node is filed in a hash
table under its handle, the digest of its prefix of two-fattest length; a binary search over
such lengths finds where a sequence leaves the trie. The compacted edges are then expanded
into one row for each depth, and the rows of all tasks are added up by digest.

Sums over subtrees need no walk down the trie: the nodes with one least member lie on one
path, such paths form a much flatter tree, and pointers in it are doubled.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.running import running
from lectern.plans.shared import saved

# A longer sequence is inserted in pieces of this many turns, each below its prefix's node.
PIECE_TURNS = 1024
# Sequences that are located against the trie before any of them is inserted.
BATCH = 1024
# Turns of new edges that a task holds before it expands its trie and starts anew.
HELD_TURNS = 1 << 20
_WIDTH = 16
ROOT = bytes(_WIDTH)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the greatest power of two."""
    return high & (-1 << (low ^ high).bit_length() - 1)


class Trie:
    """A compacted trie of sequences that are given by the digests of all their prefixes.

    Sequences begin at a root, itself a digest. ``extent`` and ``top`` are the depths below
    the root at which a node and its parent end, ``owner`` a sequence that runs through it.
    """

    def __init__(self):
        self.extent, self.top, self.parent, self.owner = [], [], [], []
        self.count, self.least = [], []
        self.digests, self.chars, self.bases = [], [], []
        self.roots: dict[bytes, int] = {}
        self.handles: dict[bytes, int] = {}
        self.edges: dict[bytes, int] = {}
        self.held = 0

    def _at(self, owner: int, depth: int) -> bytes:
        return self.digests[owner][_WIDTH * depth : _WIDTH * (depth + 1)]

    def _node(self, extent: int, top: int, parent: int, owner: int) -> int:
        for column, value in zip((self.extent, self.top, self.parent, self.owner, self.count, self.least), (extent, top, parent, owner, 0, None)):
            column.append(value)
        return len(self.extent) - 1

    def _file(self, node: int) -> None:
        top, extent, owner = self.top[node], self.extent[node], self.owner[node]
        self.handles[self._at(owner, two_fattest(top, extent))] = node
        self.edges[self._at(owner, top + 1)] = node

    def locate(self, digests: bytes, node: int) -> int:
        """The deepest node whose whole prefix the sequence has, from ``node`` downwards."""
        size = len(digests) // _WIDTH - 1
        low, high = self.extent[node], size
        while low < high:
            depth = two_fattest(low, high)
            met = self.handles.get(digests[_WIDTH * depth : _WIDTH * (depth + 1)])
            if met is None:
                high = depth - 1
                continue
            end = self.extent[met]
            if end > size or digests[_WIDTH * end : _WIDTH * (end + 1)] != self._at(self.owner[met], end):
                # The sequence leaves the trie inside this node's edge.
                return self.parent[met]
            node, low = met, end
        return node

    def insert(self, digests: bytes, chars: np.ndarray, base: int, member: int, node: int) -> None:
        """Add a sequence that has the whole prefix of ``node``."""
        node = self.locate(digests, node)
        size, depth = len(digests) // _WIDTH - 1, self.extent[node]
        if depth < size:
            child = self.edges.get(digests[_WIDTH * (depth + 1) : _WIDTH * (depth + 2)])
            if child is not None:
                owner = self.owner[child]
                low, high = depth + 1, min(size, self.extent[child])
                while low < high:
                    middle = (low + high + 1) // 2
                    if digests[_WIDTH * middle : _WIDTH * (middle + 1)] == self._at(owner, middle):
                        low = middle
                    else:
                        high = middle - 1
                depth = low
                node = self._split(child, depth)
            if depth < size:
                self.digests.append(digests)
                self.chars.append(chars)
                self.bases.append(base)
                self.held += size
                node = self._node(size, depth, node, len(self.digests) - 1)
                self._file(node)
        self.count[node] += 1
        if self.least[node] is None or member < self.least[node]:
            self.least[node] = member

    def _split(self, child: int, depth: int) -> int:
        """A new node at ``depth`` on the edge of ``child``."""
        owner, top = self.owner[child], self.top[child]
        del self.handles[self._at(owner, two_fattest(top, self.extent[child]))]
        middle = self._node(depth, top, self.parent[child], owner)
        self.top[child], self.parent[child] = depth, middle
        self._file(middle)
        self._file(child)
        return middle

    def root(self, digest: bytes) -> int:
        if digest not in self.roots:
            self.roots[digest] = self._node(0, 0, -1, -1)
        return self.roots[digest]

    def insert_batch(self, sequences: list[tuple[bytes, np.ndarray, int, int]]) -> None:
        """Locate all of a batch in the trie as it is, then insert them, each from there on."""
        found = [self.locate(digests, self.root(digests[:_WIDTH])) for digests, *_ in sequences]
        for (digests, chars, base, member), node in zip(sequences, found):
            self.insert(digests, chars, base, member, node)

    def expand(self) -> pa.RecordBatch:
        """One row for each depth of each edge, and the root of whole conversations."""
        count, least = self.count, self.least
        for node in sorted(range(len(self.extent)), key=self.extent.__getitem__, reverse=True):
            up = self.parent[node]
            if up >= 0:
                count[up] += count[node]
                least[up] = least[node] if least[up] is None else min(least[up], least[node])
        nodes = [n for n in range(len(self.extent)) if self.parent[n] >= 0]
        sizes = np.array([self.extent[n] - self.top[n] for n in nodes], np.int64)
        tables = {o: np.frombuffer(self.digests[o], "<i8").reshape(-1, 2) for o in {self.owner[n] for n in nodes}}
        none = [np.zeros((0, 2), np.int64)]
        own = np.concatenate(none + [tables[self.owner[n]][self.top[n] + 1 : self.extent[n] + 1] for n in nodes])
        up = np.concatenate(none + [tables[self.owner[n]][self.top[n] : self.extent[n]] for n in nodes])
        chars = np.concatenate([np.zeros(0, np.int64)] + [self.chars[self.owner[n]][self.top[n] : self.extent[n]] for n in nodes])
        first = np.array([self.bases[self.owner[n]] + self.top[n] + 1 for n in nodes], np.int64)
        depth = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        of_node = [np.repeat(np.array([column[n] for n in nodes], np.int64), sizes) for column in (least, count)]
        columns = [own[:, 0], own[:, 1], up[:, 0], up[:, 1], depth, chars, *of_node]
        if ROOT in self.roots:
            root = self.roots[ROOT]
            columns = [np.r_[c, v] for c, v in zip(columns, (0, 0, 0, 0, 0, 0, least[root], count[root]))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=_NODE)


_NODE = ["hi", "lo", "up_hi", "up_lo", "depth", "chars", "conv_id", "n_convs"]


def turn_codes(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, hi, lo, chars`` of every turn: its place in its conversation from 0
    and a 128-bit digest of role and text.

    Turns are ordered by ``turn``, null first; of equal ones by role and digest. A null role
    or text is empty. Turns of no conversation (null ``conv_id``) are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("bigint")
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.col("turn"), F.substring(role, 1, 16).alias("role"), digest.alias("digest"),
        F.length(text).cast("bigint").alias("chars"), F.lit(1).cast("bigint").alias("one"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    numbered = running(narrow, "conv_id", order, sums=("one",))
    return numbered.select("conv_id", (F.col("run_one") - 1).alias("place"), half(1).alias("hi"), half(17).alias("lo"), "chars")


def rebuilt(codes: DataFrame, kept: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one.

    Conversation c takes the first ``kept`` turns of conversation ``base`` (all if it has
    fewer, none if there is none), then its own turns after its first ``kept``; both are
    expressions of ``conv_id``, ``kept`` a small number. ``codes`` is a saved table of
    ``turn_codes``. Returns ``conv_id, depth, hi, lo, chars`` with depths from 1, and
    ``conv_id, size`` of every conversation.
    """
    ids = codes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    ids = ids.select("conv_id", "n_own", kept.cast("bigint").alias("kept"), base.alias("base"))
    most = ids.agg(F.max("kept")).first()[0] or 0
    turn = F.struct("place", "hi", "lo", "chars")
    heads = codes.where(F.col("place") < most).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = F.slice(F.coalesce("turns", F.array().cast("array<struct<place:bigint,hi:bigint,lo:bigint,chars:bigint>>")), F.lit(1), F.col("kept").cast("int"))
    ids = saved(ids.join(heads, "base", "left").withColumn("turns", head).withColumn("n_head", F.size("turns").cast("bigint")), "rebuilt")
    first = ids.select("conv_id", F.explode("turns").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.hi", "t.lo", "t.chars")
    own = codes.join(ids.select("conv_id", "kept", "n_head"), "conv_id").where("place >= kept")
    own = own.select("conv_id", (F.col("n_head") + F.col("place") - F.col("kept") + 1).alias("depth"), "hi", "lo", "chars")
    size = F.col("n_head") + F.greatest(F.col("n_own") - F.col("kept"), F.lit(0))
    return first.unionByName(own), ids.select("conv_id", size.alias("size"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, hi, lo, chars``: the digest of each conversation's first ``depth``
    turns, from ``turns`` with the digests of the single turns.

    It is the exclusive or of a digest of every (depth, turn), 128 bits in all.
    """
    term = lambda salt: F.xxhash64(F.lit(salt), "depth", "hi", "lo")
    terms = turns.select("conv_id", "depth", "chars", term(1).alias("hi"), term(2).alias("lo"))
    summed = running(terms, "conv_id", ["depth"], xors=("hi", "lo"))
    return summed.select("conv_id", "depth", F.col("run_hi").alias("hi"), F.col("run_lo").alias("lo"), "chars")


def _pieces(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Prefix digests gathered into rows of at most ``PIECE_TURNS`` depths and their root."""
    own = F.floor((F.col("depth") - 1) / PIECE_TURNS)
    # The last depth of a piece is the next one's root, if there is a next one.
    both = F.when(F.col("depth") % PIECE_TURNS == 0, F.array(own, own + 1)).otherwise(F.array(own))
    rows = found.withColumn("piece", F.explode(both)).groupBy("conv_id", "piece").agg(
        F.sort_array(F.collect_list(F.struct("depth", "hi", "lo", "chars"))).alias("turns")
    )
    rows = rows.select("conv_id", (F.col("piece") * PIECE_TURNS).alias("base"), "turns").where("piece = 0 OR size(turns) > 1")
    blank = F.array().cast("array<struct<depth:bigint,hi:bigint,lo:bigint,chars:bigint>>")
    none = sizes.where("size = 0").select("conv_id", F.lit(0).cast("bigint").alias("base"), blank.alias("turns"))
    return rows.unionByName(none).select("conv_id", "base", "turns.hi", "turns.lo", "turns.chars")


def _partial_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        names = ("hi", "lo", "chars")
        hi, lo, chars = (batch.column(n).flatten().to_numpy() for n in names)
        ends = np.cumsum(batch.column("hi").value_lengths().to_numpy())
        raw = np.stack([hi, lo], 1).astype("<i8").tobytes()
        waiting = []
        rows = zip(batch.column("conv_id").to_pylist(), batch.column("base").to_pylist(), np.r_[0, ends[:-1]].tolist(), ends.tolist())
        for member, base, low, high in rows:
            digests = raw[_WIDTH * low : _WIDTH * high]
            if base:
                waiting.append((digests, chars[low + 1 : high], base, member))
            else:
                waiting.append((ROOT + digests, chars[low:high], base, member))
            if len(waiting) == BATCH:
                trie.insert_batch(waiting)
                waiting = []
            if trie.held > HELD_TURNS:
                yield trie.expand()
                trie = Trie()
        trie.insert_batch(waiting)
    if trie.extent:
        yield trie.expand()


def build(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns: ``conv_id`` (least member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_sha256``.

    ``turns`` has ``conv_id, depth, hi, lo, chars`` with the digest and the length of each
    turn, ``sizes`` has ``conv_id, size`` of every conversation; one without turns is a
    member of the root alone. ``saved`` sums ``(n_convs - 1) * chars`` over a node's subtree,
    ``ends_sha256`` is over the ids of the members that end there, ascending. Without any
    conversation there is no node, not even the root.
    """
    found = saved(prefixes(turns), "prefixes")
    # The first digest below the root, which pieces after the first carry themselves.
    pieces = _pieces(found, sizes).withColumn("one", F.get("hi", F.when(F.col("base") > 0, 1).otherwise(0)))
    pieces = pieces.withColumn("two", F.get("hi", F.when(F.col("base") > 0, 2).otherwise(1)))
    # Like prefixes meet in few tasks, which the range cuts anywhere if there are many.
    dealt = pieces.repartitionByRange("base", "one", "two", "conv_id").sortWithinPartitions("base", "one", "two", "conv_id")
    partial = dealt.select("conv_id", "base", "hi", "lo", "chars").mapInArrow(_partial_nodes, ", ".join(f"{c} bigint" for c in _NODE))
    alike = [F.min(c).alias(c) for c in ("up_hi", "up_lo", "depth", "chars", "conv_id")]
    nodes = saved(partial.groupBy("hi", "lo").agg(*alike, F.sum("n_convs").alias("n_convs")), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("up"))
    nodes = nodes.join(children, ["hi", "lo"], "left").join(above, ["up_hi", "up_lo"], "left")
    zero = F.lit(0).cast("bigint")
    nodes = saved(
        nodes.select(
            "hi", "lo", "conv_id", "depth", "n_convs", F.when(F.col("depth") > 0, F.col("up")).alias("parent_conv_id"),
            F.coalesce("n_children", zero).alias("n_children"), F.col("n_children").isNull().cast("bigint").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("worth"),
        ),
        "trie",
    )
    below = _hanging(nodes)
    values = nodes.join(below, ["conv_id", "depth"], "left")
    plus = [(F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in ("leaf", "worth")]
    summed = running(
        values.select("conv_id", "depth", "hi", "lo", "parent_conv_id", "n_convs", "n_children", *plus),
        "conv_id", [F.col("depth").desc()], sums=("leaf", "worth"),
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(saved(_ends(found, sizes), "ends"), ["hi", "lo"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("run_leaf").alias("n_leaves"), F.col("run_worth").alias("saved"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def _hanging(nodes: DataFrame) -> DataFrame:
    """``conv_id, depth, more_leaf, more_worth``: the sums of all that hangs below a node
    beside its own path.

    A path is the nodes of one least member, at successive depths; it hangs from the parent
    of its first node. Each path's sum goes to the path it hangs from, then two up, four up
    and so on. What hangs from the root's path needs no sum there, which spares its heat.
    """
    own = [F.sum(c).alias(c) for c in ("leaf", "worth")]
    top = F.min(F.struct("depth", "parent_conv_id")).alias("top")
    paths = nodes.groupBy("conv_id").agg(*own, top)
    paths = saved(paths.select("conv_id", "leaf", "worth", (F.col("top.depth") - 1).alias("at"), F.col("top.parent_conv_id").alias("up")), "paths")
    root = paths.where("up IS NULL").select("conv_id").first()
    at_root = root[0] if root else 0
    state = paths.where("up IS NOT NULL").select("conv_id", "leaf", "worth", F.when(F.col("up") != at_root, F.col("up")).alias("above"))
    state = saved(state, "path-sums")
    while state.where("above IS NOT NULL").limit(1).count():
        sent = state.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaf").alias("l"), F.sum("worth").alias("w"))
        farther = state.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        zero = F.lit(0).cast("bigint")
        state = saved(
            state.join(sent, "conv_id", "left").join(farther, "above", "left").select(
                "conv_id", (F.col("leaf") + F.coalesce("l", zero)).alias("leaf"),
                (F.col("worth") + F.coalesce("w", zero)).alias("worth"), F.col("next").alias("above"),
            ),
            "path-sums",
        )
    hung = state.drop("above").join(paths.where("up IS NOT NULL").select("conv_id", "at", "up"), "conv_id")
    return hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("leaf").alias("more_leaf"), F.sum("worth").alias("more_worth")
    )


def _ends(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256`` of every node where a conversation ends.

    A node's ids pass one task in order and are hashed as they come; none is held.
    """
    last = found.groupBy("conv_id").agg(F.max(F.struct("depth", "hi", "lo")).alias("last"))
    ends = last.select("conv_id", "last.hi", "last.lo")
    zero = F.lit(0).cast("bigint")
    ends = ends.unionByName(sizes.where("size = 0").select("conv_id", zero.alias("hi"), zero.alias("lo")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: list[tuple] = []

        def give():
            columns = list(zip(*done)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["hi", "lo", "ends_sha256"])

        for batch in batches:
            for hi, lo, conv_id in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "conv_id"))):
                if (hi, lo) == node:
                    state.update(b",%d" % conv_id)
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (hi, lo), hashlib.sha256(b"%d" % conv_id)
            yield give()
            done.clear()
        if node is not None:
            done.append((*node, state.hexdigest()))
            yield give()

    ordered = ends.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv_id")
    return ordered.mapInArrow(hashed, "hi bigint, lo bigint, ends_sha256 string")
