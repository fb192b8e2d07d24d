import math

import numpy as np
from plain import union_find

from lectern.llm import forest

SCHEMA = "vec_id bigint, embedding array<float>, label string, n_links string"


def plain(rows):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    links = {i: 0 for i in ids}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, union_find(pairs, ids)


def check(spark, rows, **settings):
    found = forest.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **settings).collect()
    links, component = plain(rows)
    assert len(found) == len(rows)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], component[r.vec_id], component[r.vec_id] == r.vec_id)


def planted(n, groups, seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=16) for _ in range(n)]
    for size in groups:
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * 0.08 for _ in range(size)]
    return [(i, [float(x) for x in v], "l", "c") for i, v in enumerate(rows)]


def test_small_leaves_and_blocks(spark):
    check(spark, planted(300, [2, 3, 40, 150]), leaf_rows=64, block_rows=100, trees=12, spill=0.1)


def test_edges(spark):
    rows = planted(10, [4])
    same = rows[0][1]
    rows += [
        (100, same, "l", "c"), (101, [2 * x for x in same], "l", "c"), (100, same, "l", "c"), (None, same, "l", "c"),
        (102, None, "l", "c"), (103, [], "l", "c"), (104, [0.0] * 16, "l", "c"), (105, [float("nan")] + same[1:], "l", "c"),
        (106, [None] + same[1:], "l", "c"), (107, [float("inf")] + same[1:], "l", "c"), (108, same[:8], "l", "c"),
        (109, [-0.0] * 15 + [1.0], "l", "c"), (110, [0.0] * 15 + [1.0], "l", "c"),
    ]
    check(spark, rows)


def recall(trees, a, b):
    return np.any([forest.meet(tree, a, b) for tree in trees], axis=0).mean()


def test_recall_holds_where_vectors_spread_narrowly():
    rng = np.random.default_rng(4)
    for mean in (0.0, 0.5, 0.8):
        middle = np.sqrt(mean / (1 - mean)) * np.eye(64)[0] * 8
        x = forest.unit(rng.normal(size=(20_000, 64)) + middle)
        # Pairs that the trees are not fitted to, at 0.905, in directions of their own.
        side = rng.normal(size=(2000, 64))
        side -= x[:2000] * (x[:2000] * side).sum(1, keepdims=True)
        b = 0.905 * x[:2000] + np.sqrt(1 - 0.905**2) * forest.unit(side)
        fixed = [forest.grow(x, 64, t, 9, forest.SPILL, 11) for t in range(forest.TREES)]
        trees = forest.grown(x, 64, 9, 9, forest.TREES, forest.SPILL, forest.COSINE, 11)
        deeper = forest.grown(x, 64, 7, 9, forest.TREES, forest.SPILL, forest.COSINE, 11)
        print(mean, len(trees), len(deeper), recall(fixed, x[:2000], b), recall(trees, x[:2000], b))
        assert recall(trees, x[:2000], b) >= 0.985
        assert len(deeper) <= forest.MOST_TREES and (mean < 0.8 or len(trees) > forest.TREES)


def test_empty_table(spark):
    assert forest.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_are_parted_or_linked_whole():
    rng = np.random.default_rng(0)
    x = forest.unit(np.r_[rng.normal(size=(3000, 8)), np.ones((1500, 8)) + rng.normal(size=(1500, 8)) * 0.01])
    ids = np.arange(len(x))
    a, b = forest.spanning(x[3000:], ids[3000:], 0.9)
    # The least member needs no link to itself.
    assert set(b) == {3000} and set(a) | {3000} == set(range(3000, 4500))
    a, b = forest.spanning(x, ids, 0.99)
    found = union_find(list(zip(a.tolist(), b.tolist())), ids.tolist())
    assert len({found[i] for i in range(3000, 4500)}) == 1
