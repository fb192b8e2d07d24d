"""The plans that matter at scale, read off ``explain``."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import bayes, clean, encode, evaluate, profile, rank, split
from lectern.plans import shared
from lectern.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return re.findall(r"Exchange (?:hash|range|Single|RoundRobin)\w*(?:\([^,)]*(?:, [a-z][^,)]*)*)?", text)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "t")
    spark.range(400).select(
        F.col("id").alias("doc_id"),
        (F.col("id") % 3).cast("int").alias("label"),
        F.concat_ws(" ", *[(F.col("id") % k).cast("string") for k in range(3, 11)]).alias("text"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_cleaning_does_not_move_texts_when_copies_are_few(table):
    text = plan(clean.clean(table))
    assert "BroadcastHashJoin" in text and not shuffles(text)
    assert "Python" not in text


def test_cleaning_probes_hash_tables_when_copies_are_many(table, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    text = plan(clean.clean(table))
    assert "ShuffledHashJoin" in text and "Sort" not in text


def test_profiles_shuffle_digests_only(table):
    for df in (profile.class_profile(table), profile.length_histogram(table)):
        for exchange in re.findall(r"Exchange.*?\n(.*)", plan(df)):
            assert "text#" not in exchange.split("keys=")[0]
        assert "fingerprint" in plan(df)


def test_split_assigns_rows_without_a_shuffle(table):
    text = plan(split.stratified_split(table))
    assert not shuffles(text) and text.count("BroadcastHashJoin") == 2 and "Window" not in text


def test_row_numbers_use_no_window_over_rows(table):
    text = plan(rank.row_numbers(table.select("doc_id"), "doc_id"))
    window = text[text.index("Window"):]
    assert "HashAggregate" in window, "the window runs over part sizes"
    assert "BroadcastHashJoin" in text


def test_encoding_stays_in_the_jvm(spark, table):
    vocab = spark.createDataFrame([("[PAD]", 0), ("1", 9)], "token STRING, id INT")
    text = plan(encode.encode(table, vocab))
    assert "Python" not in text and text.count("BroadcastHashJoin") == 1
    assert [x for x in shuffles(text)] and all("_key" in x for x in shuffles(text))


def test_scoring_broadcasts_the_model_and_shuffles_sums(table):
    text = plan(bayes.score(table, bayes.scores_of(bayes.fit_counts(table))))
    assert "BroadcastHashJoin" in text and len(shuffles(text)) == 1
    below = text[text.index("Exchange hashpartitioning"):]
    assert "partial_sum" in below and "Python" not in text


def test_per_length_limit_is_applied_before_the_shuffle(table):
    text = plan(profile.rows_by_length(table, 0, 50, first=2))
    assert "WindowGroupLimit" in text[text.index("Exchange"):]


def test_lookups_and_splits_reach_the_scan(spark, table, tmp_path):
    assert "EqualTo(doc_id,7)" in plan(profile.row_at(table, 7))
    tables.write_table(table.withColumn("split", F.lit("test")), str(tmp_path / "s"), "split")
    text = plan(tables.read_split(spark, str(tmp_path / "s"), "test").select("doc_id"))
    assert "PartitionFilters: [isnotnull(split" in text and "text" not in text.split("ReadSchema")[1]


def test_counting_labels_reads_labels_only(table):
    assert re.search(r"ReadSchema: struct<label:int>", plan(profile.label_counts(table)))


def test_batch_metrics_need_no_product(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 1)], "position BIGINT, batch_id BIGINT, label INT, prediction INT"
    )
    text = plan(evaluate.batch_metrics(df, [0, 1, 2], 32))
    assert "Cartesian" not in text and "NestedLoop" not in text
