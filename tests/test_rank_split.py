import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import rank, split


def table(spark, n, labels=(0, 1), seed=1, parts=5):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    rows = [(i, rng.choice(labels)) for i in ids]
    return spark.createDataFrame(rows, "doc_id BIGINT, label INT").repartition(parts), dict(rows)


def test_positions_are_dense_and_in_order(spark):
    df, rows = table(spark, 500)
    got = {r.doc_id: r.position for r in rank.row_numbers(df, "doc_id").collect()}
    assert got == {d: i for i, d in enumerate(sorted(rows))}


def test_batches(spark):
    df, rows = table(spark, 101)
    got = rank.batches(df, 32).collect()
    assert all(r.batch_id == r.position // 32 for r in got)
    assert sorted(r.position for r in got) == list(range(101))


def test_epoch_shuffle_is_a_seeded_permutation(spark):
    df, rows = table(spark, 200)

    def order(seed, epoch):
        got = rank.batches(df, 32, seed=seed, epoch=epoch).collect()
        return [r.doc_id for r in sorted(got, key=lambda r: r.position)]

    first = order(7, 0)
    want = sorted(rows, key=lambda d: (hashlib.md5(f"7:0:{d}".encode()).hexdigest(), d))
    assert first == want
    assert first == order(7, 0) and first != order(7, 1) and first != order(8, 0)


def test_batch_totals(spark):
    df = spark.range(70).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 65, "train").otherwise("test").alias("split")
    )
    got = {r.split: (r.n_rows, r.n_batches, r.n_steps) for r in rank.batch_totals(df, 32, 3).collect()}
    assert got == {"train": (65, 3, 9), "test": (5, 1, 3)}


def by_hand(rows, parts):
    """Split assignment by sorting each class, the plain way."""
    left, out = dict(rows), {}
    for name, fraction, seed in parts:
        sizes = {}
        for label in left.values():
            sizes[label] = sizes.get(label, 0) + 1
        quotas = split.allocate(sizes, fraction)
        for label, quota in quotas.items():
            members = [d for d, c in left.items() if c == label]
            members.sort(key=lambda d: (hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d))
            for d in members[quota:]:
                out[d] = name
                del left[d]
    return out | {d: "train" for d in left}


PARTS = (("test", 0.2, 42), ("valid", 0.2, 43))


@pytest.mark.parametrize("labels", [(0, 1), (0, 0, 0, 0, 0, 1, 2, 3), (0,) * 30 + (1, 1)])
def test_split_equals_sorting_each_class(spark, labels):
    df, rows = table(spark, 700, labels)
    got = {r.doc_id: r.split for r in split.stratified_split(df, PARTS).collect()}
    assert got == by_hand(rows, PARTS)


def test_small_classes(spark):
    sizes = {0: 2, 1: 3, 2: 5, 3: 90}
    rows = [(100 * c + i, c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, label INT")
    got = {r.doc_id: r.split for r in split.stratified_split(df, PARTS[:1]).collect()}
    assert got == by_hand(dict(rows), PARTS[:1])
    assert sum(s == "test" for s in got.values()) == math.ceil(0.2 * 100)


def test_quotas_of_many_classes(spark):
    rng = random.Random(3)
    sizes = {c: 2 + rng.randint(0, 40) for c in range(5_000)}
    table_of = spark.createDataFrame(list(sizes.items()), "label INT, n BIGINT")
    for fraction in (0.2, 0.37):
        got = {r.label: r.quota for r in split.quotas(table_of, fraction).collect()}
        assert got == split.allocate(sizes, fraction)


def test_split_of_many_classes(spark):
    rows = {i: i % 5_000 for i in range(17_000)}
    df = spark.createDataFrame(list(rows.items()), "doc_id BIGINT, label INT")
    got = {r.doc_id: r.split for r in split.stratified_split(df, PARTS[:1]).collect()}
    assert got == by_hand(rows, PARTS[:1])


def test_a_row_without_label_is_refused(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "doc_id BIGINT, label INT")
    with pytest.raises(ValueError, match="1 rows have no label"):
        split.stratified_split(df)


def test_a_class_of_one_row_is_refused(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id BIGINT, label INT")
    with pytest.raises(ValueError, match="at least 2"):
        split.stratified_split(df)


@pytest.mark.parametrize("n", [2, 5, 7, 100, 1001])
def test_quotas_add_up(n):
    sizes = {c: 2 + (c * n) % 17 for c in range(6)}
    quotas = split.allocate(sizes, 0.2)
    total = sum(sizes.values())
    assert sum(quotas.values()) == total - math.ceil(0.2 * total)
    for c in sizes:
        assert 0 <= quotas[c] <= sizes[c]
        assert abs(quotas[c] - 0.8 * sizes[c]) < 1.5


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_layout_does_not_matter(spark, partitions):
    df, rows = table(spark, 300, parts=partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.doc_id: r.split for r in split.stratified_split(df, PARTS).collect()}
        numbers = {r.doc_id: r.position for r in rank.row_numbers(df, "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == by_hand(rows, PARTS)
    assert numbers == {d: i for i, d in enumerate(sorted(rows))}


def test_approximate_split(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    got = split.approximate_split(df, 0.2, 1)
    share = got.where("split = 'test'").count() / 5000
    assert 0.17 < share < 0.23
    assert got.exceptAll(split.approximate_split(df.repartition(7), 0.2, 1)).count() == 0
