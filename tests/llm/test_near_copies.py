import random

import numpy as np
from plain import SF, docs_of, edge_rows, union_find, words

from lectern.llm import superminhash
from lectern.llm.components import components
from lectern.llm.words import mix


def shingle_set(text):
    found = words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1))} if found else set()


def expected(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets[i] = shingle_set(text)
    ids = sorted(sets)
    pairs = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, union_find(pairs, ids)


def check(spark, rows):
    found = superminhash.near_copies(docs_of(spark, rows)).collect()
    sets, component = expected(rows)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id)


def test_edges(spark):
    check(spark, edge_rows())


def test_empty_table(spark):
    assert superminhash.near_copies(docs_of(spark, [])).count() == 0


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_a_chain_of_changes_and_a_large_group(spark):
    text = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        text = text.copy()
        text[i] = f"new{i}"
        rows.append((100 - i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"v{j}" for j in range(200)) + f" tail{i}") for i in range(300)]
    check(spark, rows)


def test_long_words_of_doubling_sequences_differ(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    other = " ".join(f"w{i}" for i in range(6))
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{other} {one}"), (5, f"{other} {two}"), (6, f"{other} {one}")]
    check(spark, rows)


def test_bands_miss_few_pairs():
    # Pairs at a similarity of exactly 0.75: 300 shared shingles of 400.
    rng = np.random.default_rng(1)
    n, text = 60, np.repeat(np.arange(2), [350, 350])
    missed = 0
    for _ in range(n):
        common = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        sides = [np.r_[common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)] for _ in range(2)]
        marks = superminhash.signatures(np.concatenate(sides), text, 2, superminhash.BANDS * superminhash.ROWS)
        bands = (marks[0] == marks[1]).reshape(superminhash.BANDS, superminhash.ROWS).all(1)
        assert bands.sum() >= 2
        missed += not bands.any()
    assert missed == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])
    both = superminhash.signatures(np.r_[a, b], np.repeat([0, 1], 300), 2, 160)
    assert abs((both[0] == both[1]).mean() - 240 / 360) < 0.12
    one = superminhash.signatures(mix(a[:1]), np.zeros(1, int), 1, 160)[0]
    # A single element meets every bin once, each with a rank of its own step.
    assert sorted(np.floor(one).astype(int)) == list(range(160))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 40)] + [(7, 7), (300, 299), (301, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = sorted({x for pair in links for x in pair if pair[0] != pair[1]})
    assert found == union_find([p for p in links if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_remaining_pairs_are_complete(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(8, 40))] for _ in range(12)]
    rows = []
    for i in range(160):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(text[rng.randint(0, 3) if rng.random() < 0.3 else 0 :]), i))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, component bigint")
    got = {tuple(r) for r in superminhash.remaining_pairs(table, 75).collect()}
    sets = {i: shingle_set(t) for i, t, _ in rows}
    want = {
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    assert want and want <= got
    sizes = {(r.a, r.b): (r.common, r.either) for r in superminhash.verify(table, spark.createDataFrame(sorted(want), "a bigint, b bigint")).collect()}
    assert sizes == {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in want}
