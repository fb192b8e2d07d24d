import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from plain import SF

from lectern.llm import queries, running, zfast
from lectern.plans.shared import saved

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, part int, hi double"


def plain(rows):
    """Nodes of the trie of rebuilt conversations, by the contract's words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, worth = defaultdict(int), defaultdict(int)
    for path, of in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            worth[path[:d]] += (len(of) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (of[0], len(path), members[path[:-1]][0] if path else None, len(of), children.get(path, 0), leaves[path], worth[path],
         hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest())
        for path, of in members.items()
    )


def found(spark, rows, monkeypatch, parts=3):
    table = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(parts)
    monkeypatch.setattr(queries, "table", lambda *_: table)
    nodes = queries.op13_prefix_trie(spark, "")
    assert nodes.columns == COLUMNS
    return sorted(tuple(r) for r in nodes.collect())


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 650), n):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 30])):
            rows.append((c, turn * 3, rng.choice(["user", "assistant"]), rng.choice("aé日") * rng.randint(0, 2)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, monkeypatch, seed):
    rows = conversations(seed)
    if seed == 2:
        for module, name, value in ((zfast, "PIECE_TURNS", 4), (zfast, "BATCH", 3), (zfast, "HELD_TURNS", 40)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(seed)
    rows += [(None, 1, "user", "lost"), (700, None, None, None), (700, 1, "user", "b"), (700, 1, "user", "b"), (700, 1, "user", "a")]
    # One conversation with a third of all turns, and copies of another.
    rows += [(801, t, "user", rng.choice("ab")) for t in range(len(rows) // 2)]
    rows += [(c, t, "user", f"same {t}") for c in range(900, 960) for t in range(8)]
    # Turns that the base does not have, so that nothing is left of some of these.
    rows += [(c, 0, "user", "only") for c in range(1001, 1030)]
    assert found(spark, rows, monkeypatch) == plain(rows)


def test_empty_table(spark, monkeypatch):
    assert found(spark, [], monkeypatch) == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nodes = queries.op13_prefix_trie(spark, SF).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in nodes) == plain(rows)


def test_deep_paths_hang_from_each_other(spark):
    """A comb: each sequence leaves the one before at its end, so paths nest deeply."""
    rows = []
    for c in range(40):
        rows += [(c, d, 0, min(d, c + 1) * 100 + (0 if d <= c + 1 else c + 1), 1) for d in range(1, 45)]
    turns = spark.createDataFrame(rows, "conv_id bigint, depth bigint, hi bigint, lo bigint, chars bigint")
    sizes = turns.groupBy("conv_id").count().withColumnRenamed("count", "size")
    nodes = zfast.build(turns, sizes).collect()
    paths = {c: [lo for (x, _, _, lo, _) in rows if x == c] for c in range(40)}
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(45):
            members[tuple(path[:d])].append(c)
    assert {(r.conv_id, r.depth): (r.n_convs, r.n_leaves) for r in nodes} == {
        (m[0], len(p)): (len(m), len(m)) for p, m in members.items()
    }


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert zfast.two_fattest(low, high) == best


def test_running_over_cut_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 2, 2, 2, 3, 9]), i, rng.randint(-9, 9), rng.getrandbits(63)) for i in range(500)]
    df = spark.createDataFrame(rows, "g bigint, at bigint, x bigint, y bigint").repartition(5)
    total, wanted = defaultdict(lambda: [0, 0]), {}
    for g, at, x, y in sorted(rows):
        total[g][0] += x
        total[g][1] ^= y
        wanted[at] = tuple(total[g])
    found = running.running(df, "g", ["at"], sums=("x",), xors=("y",)).collect()
    assert {r.at: (r.run_x, r.run_y) for r in found} == wanted
    assert saved(df, "t").count() == len(found)
