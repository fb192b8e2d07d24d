import random

import pytest

from lectern.sources import tables
from lectern.sources.delimited import read_quoted

SCHEMA = "label INT, text STRING"


def write(path, records, sep, end="\n"):
    def field(text):
        quoted = any(c in text for c in (sep, '"', "\n", "\r")) or text != text.strip() or text == ""
        return '"' + text.replace('"', '""') + '"' if quoted else text

    path.write_text("".join(f"{label}{sep}{field(text)}{end}" for label, text in records), encoding="utf-8", newline="")


def records(seed, n=200):
    rng = random.Random(seed)
    parts = ["plain", "é日", "\n", "\n\n", '"', '""', " ", "\t", "x" * 40, ",", "\r\n", "end"]
    return [(rng.randint(0, 3), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for _ in range(n)]


def read(rows):
    """As Spark's reader has it, an empty field is null, in quotes or not."""
    return [(label, text or None) for label, text in rows]


@pytest.mark.parametrize("sep, size", [("\t", 200), (" ", 200), ("\t", 1 << 20)])
def test_one_file_in_many_blocks(spark, tmp_path, sep, size):
    rows = records(size) + [(1, "a\n" * 200 + '"'), (2, "last")]
    write(tmp_path / "corpus.txt", rows, sep)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        blocks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        found = read_quoted(spark, str(tmp_path), SCHEMA, sep).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert blocks > 10 or size > 1000
    assert sorted((r.doc_id, r.label, r.text) for r in found) == [(i, *row) for i, row in enumerate(read(rows))]
    whole = tables.read_text_corpus(spark, str(tmp_path), sep).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(((r.label, r.text) for r in found), key=repr)


def test_files_follow_each_other(spark, tmp_path):
    parts = [records(s, 40) for s in range(3)]
    for number, rows in zip((2, 10, 9), parts):
        write(tmp_path / f"part-{number}-x.csv", rows, "\t")
    found = read_quoted(spark, str(tmp_path), SCHEMA, name="place").collect()
    want = parts[0] + parts[2] + parts[1]
    assert sorted((r.place, r.label, r.text) for r in found) == [(i, *row) for i, row in enumerate(read(want))]


def test_carriage_returns_and_empty_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b'1\tone\r\n\r\n\n2\t"two\r\n\r\nlines"\r\n3\t\r\n\n')
    found = read_quoted(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(map(tuple, found)) == [(1, "one", 0), (2, "two\r\n\r\nlines", 1), (3, None, 2)]


def test_an_open_quote_ends_with_its_file(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text('1\tone\n2\t"never closed\n3\tthree\n')
    (tmp_path / "part-1.txt").write_text("4\tfour\n")
    found = {r.doc_id: r.label for r in read_quoted(spark, str(tmp_path), SCHEMA).collect()}
    assert found == {0: 1, 1: 2, 2: 4}


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert read_quoted(spark, str(tmp_path), SCHEMA).count() == 0


def test_round_trip_of_what_the_library_writes(spark, corpus, tmp_path):
    rows = records(9, 120) + [(0, ""), (1, None)]
    df = corpus(rows)
    tables.write_text_corpus(df, str(tmp_path / "out"))
    found = {r.doc_id: (r.label, r.text) for r in read_quoted(spark, str(tmp_path / "out"), SCHEMA).collect()}
    assert found == dict(enumerate(read((label, text or "") for label, text in rows)))
