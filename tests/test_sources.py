import json
import types

import pytest
from pyspark.sql import functions as F

from lectern.plans import shared
from lectern.sources import runs, tables
from lectern.streaming.rows import clean_rows


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text('0\t padded text \n1\t"say ""hi"" now"\n2\t\n3\tNA\n0\t"two\nlines"\n', encoding="utf-8")
    df = tables.number_rows(tables.read_text_corpus(spark, str(path)))
    rows = {r.doc_id: (r.label, r.text) for r in df.collect()}
    assert rows == {
        0: (0, " padded text "), 1: (1, 'say "hi" now'), 2: (2, None), 3: (3, "NA"), 4: (0, "two\nlines"),
    }


def test_space_separated_text(spark, tmp_path):
    path = tmp_path / "cleaned.txt"
    path.write_text('0 "one two"\n1 three\n', encoding="utf-8")
    df = tables.read_text_corpus(spark, str(path), sep=" ")
    assert sorted(map(tuple, df.collect())) == [(0, "one two"), (1, "three")]


@pytest.mark.parametrize("sep", ["\t", " "])
def test_text_round_trip(spark, corpus, tmp_path, sep):
    texts = [" a ", 'q "x" y', "tab\there", "two\nlines", "a", "\\ back", "é", "comma, semi;"]
    path = str(tmp_path / "out")
    tables.write_text_corpus(corpus([(i % 3, t) for i, t in enumerate(texts)]), path, sep=sep)
    df = tables.number_rows(tables.read_text_corpus(spark, path, sep=sep))
    assert {r.doc_id: (r.label, r.text) for r in df.collect()} == {
        i: (i % 3, t) for i, t in enumerate(texts)
    }


def test_rows_are_numbered_across_blocks_and_files(spark, tmp_path):
    for part in range(3):
        lines = "".join(f"{i % 4}\tline {part * 4000 + i}\n" for i in range(4000))
        (tmp_path / f"part-{part}.txt").write_text(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = tables.read_text_corpus(spark, str(tmp_path), quoted_newlines=False)
        assert df.rdd.getNumPartitions() > 12
        wrong = tables.number_rows(df).where(F.col("text") != F.concat(F.lit("line "), "doc_id"))
        assert wrong.count() == 0
        assert tables.number_rows(df).select("doc_id").distinct().count() == 12000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_json_array_is_read_in_blocks(spark, tmp_path):
    arrays = [[i, -i, 7, 0] for i in range(5000)]
    path = tmp_path / "token_ids.json"
    path.write_text(json.dumps(arrays))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tables.read_json_arrays(spark, str(path), "token_ids").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.token_ids for r in sorted(got, key=lambda r: r.position)] == arrays


@pytest.mark.parametrize("text", ["[[1,2],[],[3,4]]", "[1,2]\n[]\n[3,4]\n", "[[1, 2],\n [ ],\n [3, 4]]\n"])
def test_empty_arrays_are_records(spark, tmp_path, text):
    path = tmp_path / "ids.json"
    path.write_text(text)
    got = tables.read_json_arrays(spark, str(path), "ids").collect()
    assert [r.ids for r in sorted(got, key=lambda r: r.position)] == [[1, 2], [], [3, 4]]


def test_part_files_are_in_the_order_of_their_numbers(spark, tmp_path):
    for i, part in enumerate(["part-99999", "part-100000", "part-100001"]):
        (tmp_path / f"{part}-x.txt").write_text(f"{i}\tline\n")
    df = tables.number_rows(tables.read_text_corpus(spark, str(tmp_path)))
    assert sorted((r.doc_id, r.label) for r in df.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_array_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(5, [1, 2]), (3, [0, 0]), (9, [4, -4])], "doc_id BIGINT, ids ARRAY<INT>")
    tables.write_json_arrays(df, "ids", str(tmp_path / "ids"))
    got = tables.read_json_arrays(spark, str(tmp_path / "ids"), "ids").collect()
    assert [r.ids for r in sorted(got, key=lambda r: r.position)] == [[0, 0], [1, 2], [4, -4]]


def test_writing_twice_leaves_the_same_rows(spark, corpus, tmp_path):
    df = corpus([(0, "a"), (1, "b")]).withColumn("split", F.lit("train"))
    for _ in range(2):
        tables.write_table(df, str(tmp_path / "t"), partition_by="split")
    assert tables.read_split(spark, str(tmp_path / "t"), "train").count() == 2
    assert tables.read_split(spark, str(tmp_path / "t"), "test").count() == 0
    assert tables.read_table(spark, str(tmp_path / "t"), "doc_id BIGINT, label INT").count() == 2


def test_run_records_replace(spark, tmp_path):
    params, metrics = str(tmp_path / "params"), str(tmp_path / "metrics")
    runs.record_params(spark, params, "r1", {"batch_size": 32, "num_epochs": 3})
    runs.record_params(spark, params, "r2", {"batch_size": 64})
    assert runs.read_params(spark, params).count() == 3
    values = spark.createDataFrame([(0.5, 0.75)], "loss DOUBLE, accuracy DOUBLE")
    for epoch in (0, 1, 1):
        runs.record_metrics(values, metrics, "r1", epoch, "train")
    rows = sorted(map(tuple, runs.read_metrics(spark, metrics).collect()))
    assert rows == [
        ("r1", 0, "train", "accuracy", 0.75), ("r1", 0, "train", "loss", 0.5),
        ("r1", 1, "train", "accuracy", 0.75), ("r1", 1, "train", "loss", 0.5),
    ]


def session(**settings):
    """A stand-in that answers only what ``shared_dir`` asks."""
    context = types.SimpleNamespace(applicationId="app")
    return types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
        sparkContext=context,
    )


def test_shared_folder_is_the_configured_one():
    cluster = session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared.scratch_path(cluster, "x").startswith("hdfs:///shared/lectern/app/x-")


def test_without_a_shared_folder_the_warehouse_is_used():
    plain = session(**{"spark.master": "local[2]", "spark.sql.warehouse.dir": "file:/w"})
    assert shared.shared_dir(plain) == "file:/w/scratch"


def test_scratch_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    kept = shared.saved(spark.range(3), "x")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    shared.drop_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_row_wise_cleaning_of_a_stream(spark, corpus, tmp_path):
    pairs = [(0, " a b c d e f "), (1, ""), (0, "short one"), (2, "g h i j k l m"), (0, "a b c d e f")]
    batch = corpus(pairs)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        clean_rows(stream).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .start(str(tmp_path / "out"))
    )
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, clean_rows(batch).collect()))
    assert got.count() == 3
