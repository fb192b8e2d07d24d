"""Links between near-equal vectors by a forest of random-projection trees."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import longs
from lectern.llm.components import components
from lectern.llm.sample import least_hashes
from lectern.plans.shared import saved

COSINE = 0.9
# Least number of trees; more are grown until this share of pairs planted at the least
# cosine, in directions in which the vectors spread, meet in a leaf.
TREES = 12
RECALL = 0.995
PLANTED = 4000
# The number of a tree is eight bits of a leaf's key.
MOST_TREES = 255
# Share of a node's rows on either side of its split that go to both children.
SPILL = 0.06
# Vectors that the upper splits are fitted on at most; every vector is routed by them.
SAMPLE_ROWS = 100_000
# Rows of a leaf, about; a node of the sample is split while it has this many itself.
LEAF_ROWS = 1024
SAMPLE_LEAF = 32
# Rows of one key that one task holds; larger groups are compared block against block.
BLOCK_ROWS = 8192


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision without overflow."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(dim: int, tree: int, depth: int, seed: int) -> np.ndarray:
    """One random direction for each level of a tree."""
    drawn = np.random.default_rng([seed, dim, tree]).normal(size=(dim, depth))
    return drawn / np.linalg.norm(drawn, axis=0)


@dataclass(frozen=True)
class Tree:
    """Splits of one dimension and tree: a row goes left up to ``high``, right from ``low``."""

    lines: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row, leaf`` of unit vectors; rows near a split are in several leaves."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.lines.shape[1]):
            at = (x @ self.lines[:, level])[row]
            left, right = at <= self.high[node], at >= self.low[node]
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node


def grow(x: np.ndarray, dim: int, tree: int, depth: int, spill: float, seed: int) -> Tree:
    lines = directions(dim, tree, depth, seed)
    low, high = np.zeros(2**depth - 1), np.zeros(2**depth - 1)
    member: dict[int, np.ndarray] = {0: np.arange(len(x))}
    for level in range(depth):
        at = x @ lines[:, level] if len(x) else np.zeros(0)
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = member.pop(node, np.zeros(0, np.int64))
            if len(mine) >= 4:
                low[node], high[node] = np.quantile(at[mine], [0.5 - spill, 0.5 + spill])
            member[2 * node + 1] = mine[at[mine] <= high[node]]
            member[2 * node + 2] = mine[at[mine] >= low[node]]
    return Tree(lines, low, high)


def planted(x: np.ndarray, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at ``cosine``: vectors of ``x``, each turned towards another one."""
    rng = np.random.default_rng([seed, len(x)])
    a, other = (x[rng.integers(0, max(len(x), 1), PLANTED if len(x) else 0)] for _ in range(2))
    side = other - a * (a * other).sum(1, keepdims=True)
    size = np.linalg.norm(side, axis=1)
    apart = size > 1e-9
    a, side = a[apart], side[apart] / size[apart, None]
    return a, cosine * a + np.sqrt(1 - cosine**2) * side


def meet(tree: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``a`` and ``b`` share a leaf, row by row."""
    leaves = 2 ** (tree.lines.shape[1] + 1)
    row, leaf = tree.leaves(a)
    other_row, other_leaf = tree.leaves(b)
    there = np.isin(row * leaves + leaf, other_row * leaves + other_leaf)
    return np.bincount(row[there], minlength=len(a)) > 0


def grown(x: np.ndarray, dim: int, depth: int, wanted: int, trees: int, spill: float, cosine: float, seed: int) -> list[Tree]:
    """Trees of ``depth`` levels, ``trees`` or as many more as the planted pairs need.

    Pairs part more often the deeper the trees are and the narrower the vectors spread. If
    the sample allows fewer levels than are ``wanted``, leaves are split on later, and trees
    are added for the pairs that these levels part at the same rate.
    """
    a, b = planted(x, cosine, seed)
    out, missed, met = [], np.ones(len(a), bool), []
    least = trees
    while len(out) < least:
        out.append(grow(x, dim, len(out), depth, spill, seed))
        met.append(meet(out[-1], a, b))
        missed &= ~met[-1]
        if len(out) == least and len(a):
            if missed.mean() > 1 - RECALL:
                least = min(least + 1, MOST_TREES)
            elif wanted > depth > 0:
                stay = np.mean(met) ** (1 / depth)
                least, wanted = min(int(np.ceil(least / stay ** (wanted - depth))), MOST_TREES), depth
    return out


def _blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows with ``key`` dealt into groups ``key, i, j`` of at most two blocks each, about.

    A key of one block is one group. Every two rows of a key meet in some group; no pair
    of rows is made.
    """
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    dealt = rows.join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("vec_id", F.lit(5)), "blocks"))
    # One block needs its own group only; of more, each meets all.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        dealt.withColumn("other", other)
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "vec_id")
    )


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """``i, j, {column: values}`` of each group of sorted rows, across batch borders."""
    held, group = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], 1)
        if not len(keys):
            continue
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        for low, high in zip(edges, np.r_[edges[1:], len(keys)]):
            if group is not None and tuple(keys[low]) != group:
                yield group[1], group[2], _joined(held, columns)
                held = []
            group = tuple(keys[low])
            held.append(batch.slice(low, high - low))
    if group is not None:
        yield group[1], group[2], _joined(held, columns)


def _joined(parts, columns):
    out = {c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in columns}
    flat = np.concatenate([p.column("embedding").flatten().to_numpy(zero_copy_only=False) for p in parts])
    return out | {"x": unit(flat.reshape(len(out[columns[0]]), -1))}


def _tight(x: np.ndarray, cosine: float) -> bool:
    """Whether all members lie within half the angle of their middle, so that all are linked."""
    centre = x.mean(0)
    size = np.linalg.norm(centre)
    return size > 0 and 2 * np.arccos(np.clip(x @ (centre / size), -1, 1)).max() < np.arccos(cosine) - 1e-9


def labels(x: np.ndarray, ids: np.ndarray, cosine: float) -> np.ndarray:
    """The least id that each vector reaches by links within the group, compared whole."""
    out = ids.copy()
    while True:
        new = out.copy()
        for low in range(0, len(x), LEAF_ROWS):
            near = x[low : low + LEAF_ROWS] @ x.T >= cosine
            least = np.where(near, out, np.iinfo(np.int64).max).min(1)
            new[low : low + LEAF_ROWS] = np.minimum(new[low : low + LEAF_ROWS], least)
        if (new == out).all():
            return out
        out = new


def spanning(x: np.ndarray, ids: np.ndarray, cosine: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a, b`` that connect what is linked within a group, few for each row.

    A tight group is linked as it is. A large one is split on, at random with overlap, as
    long as that parts it; what is small or cannot be parted is compared whole.
    """
    if len(x) > 2 * LEAF_ROWS:
        if _tight(x, cosine):
            return ids, np.full(len(ids), ids.min())
        line = np.random.default_rng([seed, len(x)]).normal(size=x.shape[1])
        at = x @ (line / np.linalg.norm(line))
        low, high = np.quantile(at, [0.5 - SPILL, 0.5 + SPILL])
        left, right = np.flatnonzero(at <= high), np.flatnonzero(at >= low)
        if max(len(left), len(right)) < 0.8 * len(x):
            parts = [spanning(x[side], ids[side], cosine, seed + 1) for side in (left, right)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    found = labels(x, ids, cosine)
    linked = found != ids
    return ids[linked], found[linked]


def _links(cosine: float) -> Callable:
    def run(batches):
        for _, _, group in _groups(batches, ["vec_id"]):
            a, b = spanning(group["x"], group["vec_id"], cosine)
            yield pa.RecordBatch.from_arrays([longs(a), longs(b)], names=["a", "b"])

    return run


def _counts(cosine: float) -> Callable:
    def run(batches):
        for i, j, group in _groups(batches, ["vec_id", "copies", "mine"]):
            x, copies, mine = group["x"], group["copies"], group["mine"]
            total = np.zeros(len(x), np.int64)
            for low in range(0, len(x), LEAF_ROWS):
                near = x[low : low + LEAF_ROWS] @ x.T >= cosine
                near[np.arange(len(near)), np.arange(low, low + len(near))] = False
                if i != j:
                    near &= mine[low : low + LEAF_ROWS, None] != mine
                total[low : low + LEAF_ROWS] = near @ copies
            yield pa.RecordBatch.from_arrays([longs(group["vec_id"]), longs(total)], names=["vec_id", "n"])

    return run


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(
    classes: DataFrame, trees: int, sample_rows: int, leaf_rows: int, spill: float, cosine: float, seed: int
) -> dict[int, list[Tree]]:
    """Upper splits for each dimension from at most ``sample_rows`` vectors."""
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    sample = least_hashes(classes.select("vec_id", "dim", "embedding"), "vec_id", sample_rows, total, seed).collect()
    out = {}
    for dim, n in sizes.items():
        mine = np.array([r.embedding for r in sample if r.dim == dim], np.float64).reshape(-1, dim)
        x = unit(mine) if len(mine) else mine
        wanted = max(0, int(np.ceil(np.log2(max(n, 1) / leaf_rows))))
        depth = min(wanted, int(np.log2(max(len(x) / SAMPLE_LEAF, 1)))) if total > sample_rows else wanted
        out[dim] = grown(x, dim, depth, wanted, trees, spill, cosine, seed)
    return out


def near_vectors(
    rows: DataFrame,
    cosine: float = COSINE,
    trees: int = TREES,
    spill: float = SPILL,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 11,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Equal vectors form a class that is indexed once. Every class is routed through all
    trees, into several leaves where it lies near a split, and compared within its leaves;
    components of the verified links are found on the executors. A link joins two members
    of a component, so the links of each vector are then counted exactly inside its
    component, block against block, without making pairs. Vectors that are null, empty,
    zero or not finite link with nothing, nor do vectors of different lengths. Rows
    repeated under one id with the same vector count once; an id with different vectors is
    one node that joins what each of them links. A row without an id has no links, no
    component, and is not kept. ``trees`` is the least number of trees.
    """
    spark = rows.sparkSession
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    hashes = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2")]
    good = rows.where("ok").select("vec_id", *hashes, "embedding")
    keys = ["k1", "k2"]
    one = F.min(F.struct("vec_id", "embedding")).alias("one")
    classes = saved(
        good.groupBy(*keys).agg(one, F.count_distinct("vec_id").alias("copies")).select(
            *keys, "one.vec_id", "one.embedding", "copies", F.size("one.embedding").alias("dim")
        ),
        "classes",
    )
    forest = spark.sparkContext.broadcast(fit(classes, trees, sample_rows, leaf_rows, spill, cosine, seed))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = forest.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(part.column("embedding").flatten().to_numpy().reshape(-1, int(dim)))
                for number, tree in enumerate(fitted[int(dim)]):
                    row, leaf = tree.leaves(x)
                    key = (int(dim) << 44) + (number << 36) + leaf
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [longs(key), taken.column("vec_id"), taken.column("embedding")], names=["key", "vec_id", "embedding"]
                    )

    kind = dict(classes.dtypes)["embedding"]
    routed = classes.select("vec_id", "embedding", "dim").mapInArrow(route, f"key bigint, vec_id bigint, embedding {kind}")
    groups = _blocked(routed, block_rows).select("key", "i", "j", "vec_id", "embedding")
    links = groups.mapInArrow(_links(cosine), "a bigint, b bigint")
    found = saved(components(links), "component")

    inside = classes.join(found.withColumnRenamed("node", "vec_id"), "vec_id").select(
        F.col("component").alias("key"), "vec_id", "embedding", "copies"
    )
    groups = _blocked(inside, block_rows).select("key", "i", "j", "vec_id", "embedding", "copies", "mine")
    counted = groups.mapInArrow(_counts(cosine), "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = (
        classes.select(*keys, "vec_id", "copies")
        .join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .join(counted, "vec_id", "left")
        .select(
            *keys,
            F.coalesce("component", "vec_id").alias("component"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        )
    )
    ids = rows.select("vec_id", *[F.when(F.col("ok"), k).alias(name) for k, name in zip(hashes, keys)])
    joined = ids.join(named, keys, "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
