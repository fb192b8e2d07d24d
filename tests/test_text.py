import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.arrays import argmax, frame_ids, mask, pad_right

BLANKS = [chr(i) for i in range(0x110000) if chr(i).isspace()]


def test_the_blank_list_is_pythons():
    assert sorted(text.WHITESPACE) == BLANKS


def test_strip_and_tokens_follow_python_for_every_blank(spark):
    texts = [w for w in BLANKS] + [f"{w}a{w}" for w in BLANKS] + [f"{w}{w}a{w} {w}b" for w in BLANKS]
    texts += ["", "a", "​ a", "NA", "".join(BLANKS), "a" + "".join(BLANKS) + "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    df = df.withColumn("s", text.strip("text")).select(
        "text", "s", text.tokens("s").alias("t"), text.n_tokens("s").alias("n"),
        *[text.has_tokens("s", k).alias(f"has{k}") for k in range(4)],
    )
    for row in df.collect():
        want = row.text.split()
        assert (row.s, row.t, row.n) == (row.text.strip(), want, len(want)), repr(row.text)
        assert [row[f"has{k}"] for k in range(4)] == [len(want) >= k for k in range(4)]


def test_null_counts_as_empty(spark):
    df = spark.createDataFrame([(None,)], "text STRING")
    assert df.select(text.strip("text").alias("s")).first().s == ""
    assert df.select(F.size(text.words("text")).alias("n")).first().n == 0


@pytest.mark.parametrize(
    "given, want",
    [
        ("Élan VITAL", ["elan", "vital"]),
        ("Straße", ["straße"]),
        ("don't--stop...", ["don", "'", "t", "-", "-", "stop", ".", ".", "."]),
        ("áb", ["ab"]),
        ("x\u0000y​z�", ["xyz"]),
        ("日本go", ["日", "本", "go"]),
        ("“q” ¿", ["“", "q", "”", "¿"]),
        ("a$b^c", ["a", "$", "b", "^", "c"]),
        ("tab\tline\nnbsp end", ["tab", "line", "nbsp", "end"]),
    ],
)
def test_words(spark, given, want):
    df = spark.createDataFrame([(given,)], "text STRING")
    assert df.select(text.words("text").alias("w")).first().w == want


def test_accents_stay_when_asked(spark):
    df = spark.createDataFrame([("Élan",)], "text STRING")
    assert df.select(text.words("text", fold_accents=False).alias("w")).first().w == ["élan"]


def test_frames(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 9, 10],), ([5],), ([],)], "ids ARRAY<INT>")
    framed = frame_ids(F.col("ids"), 6, 2, 3)
    rows = df.select(
        pad_right(framed, 6, 0).alias("ids"), mask(F.size(framed), 6).alias("mask")
    ).collect()
    assert [r.ids for r in rows] == [[2, 5, 6, 7, 8, 3], [2, 5, 3, 0, 0, 0], [2, 3, 0, 0, 0, 0]]
    assert [r["mask"] for r in rows] == [[1] * 6, [1, 1, 1, 0, 0, 0], [1, 1, 0, 0, 0, 0]]


def test_argmax_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 2.0],), ([-5.0, -1.0],)], "z ARRAY<DOUBLE>")
    assert [r.a for r in df.select(argmax("z").alias("a")).collect()] == [1, 0, 1]
