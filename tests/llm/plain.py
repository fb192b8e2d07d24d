"""Fixtures and plain versions that the operators are compared with."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, parts=3):
    """``doc_id, text`` and columns whose names operators may use themselves."""
    full = [(i, text, "x", "y", 7, 0.5) for i, text in rows]
    schema = "doc_id bigint, text string, language string, n_tokens string, component bigint, score double"
    return spark.createDataFrame(full, schema).repartition(parts)


def edge_rows(seed=5):
    """Null and empty texts, a missing id, ties, repeated rows, one very long text."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "ñandú", "日本語", "x1", "delta,", "omega."]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    base = make(60)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "one two three four"), (7, base), (8, base)]
    changed = base.split(" ")
    changed[30] = "changed"
    rows += [(9, " ".join(changed)), (9, " ".join(changed)), (None, base), (None, None)]
    rows += [(20 + i, make(40) + "\n" + base[:150] + "\n" + make(10)) for i in range(6)]
    rows += [(40, make(30_000)), (41, "z" * 5_000), (42, "ab " * 3_000)]
    return rows


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOW))


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
