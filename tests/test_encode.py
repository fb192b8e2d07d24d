import random

import pytest
from pyspark.sql import functions as F
from tokenizers import BertWordPieceTokenizer

from lectern.operators import encode, join
from lectern.sources.tables import read_vocab

# [PAD] [UNK] [CLS] [SEP] take the first four ids.
TOKENS = [
    *encode.SPECIAL_TOKENS, "the", "un", "##aff", "##able", "##a", "##b", "a", "b", "##ff", "run",
    "##ning", ".", ",", "'", "elan", "##s", "x", "##x", "日", "##le", "[", "]", "-",
]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(
        [(t, i) for i, t in enumerate(TOKENS)], "token STRING, id INT"
    )


@pytest.fixture(scope="module")
def published(tmp_path_factory):
    path = tmp_path_factory.mktemp("vocab") / "vocab.txt"
    path.write_text("\n".join(TOKENS) + "\n", encoding="utf-8")
    tokenizer = BertWordPieceTokenizer(str(path), lowercase=True)
    tokenizer.enable_truncation(128)
    tokenizer.enable_padding(length=128)
    return str(path), tokenizer


def texts():
    rng = random.Random(3)
    parts = [
        "the", "Unaffable", "unaff", "RUNNING", "run", "élan", "Élans", "xx", "x" * 100, "x" * 101,
        "qqq", "unq", "日", "日日", "a", "b.", "don't", "a-b", "...", "\t", "\u0000a", " ",
        "áb", "​b", "abab", "ble", "“the”", "the,the", "ｘ",
    ]
    fixed = ["", " ", "qqq", "the " * 125, "the " * 126, "the " * 127, "the " * 300, "xxx " * 60]
    return fixed + [" ".join(rng.choices(parts, k=rng.randint(1, 140))) for _ in range(60)]


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_encoding_equals_the_published_tokenizer(corpus, vocab, published, broadcast_bytes):
    """With the vocabulary and the lexicon broadcast, and joined."""
    given = texts()
    df = encode.encode(
        corpus([(0, t) for t in given]), vocab, keep=("label",), broadcast_bytes=broadcast_bytes
    )
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(given)
    for i, text in enumerate(given):
        want = published[1].encode(text)
        assert rows[i].token_ids == want.ids, text
        assert rows[i].attention_mask == want.attention_mask, text
        assert rows[i].truncated == bool(want.overflowing), text
        assert len(rows[i].token_ids) == len(rows[i].attention_mask) == 128


def test_join_path_with_a_shuffled_vocabulary(spark, corpus, vocab, published, monkeypatch):
    monkeypatch.setattr(encode, "small_side", lambda df, limit=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = texts()[-10:]
        df = encode.encode(corpus([(0, t) for t in given]), vocab, broadcast_bytes=0)
        rows = {r.doc_id: r.token_ids for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {i: published[1].encode(t).ids for i, t in enumerate(given)}


def test_pieces_of_single_words(spark, vocab):
    words = ["unaffable", "running", "the", "unq", "q", "xxx", "x" * 100, "x" * 101, "b"]
    df = spark.createDataFrame([(w,) for w in words], "word STRING")
    got = {r.word: r.ids for r in encode.spell(df, vocab, 1).collect()}
    ids = {t: i for i, t in enumerate(TOKENS)}
    assert got["unaffable"] == [ids["un"], ids["##aff"], ids["##able"]]
    assert got["running"] == [ids["run"], ids["##ning"]] and got["the"] == [ids["the"]]
    assert got["unq"] == [1] == got["q"]
    assert got["xxx"] == [ids["x"], ids["##x"], ids["##x"]]
    assert len(got["x" * 100]) == 100 and got["x" * 101] == [1]


def test_supplied_vocabulary(spark, vocab, published):
    read = read_vocab(spark, published[0])
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, vocab.collect()))
    assert encode.special_ids(read) == encode.Specials()
    with pytest.raises(ValueError, match="lacks"):
        encode.special_ids(read.where("token <> '[SEP]'"))


def test_build_vocab(corpus):
    df = corpus([(0, "aa aa aa bb bb c"), (1, "aa dd dd! dd c c c")])
    got = {r.token: r.id for r in encode.build_vocab(df, min_count=2).collect()}
    # aa 4, c 4 (alone, as a start), then letters and words by count and token.
    counts = {"##a": 4, "a": 4, "aa": 4, "c": 4, "##d": 3, "d": 3, "dd": 3, "##b": 2, "b": 2, "bb": 2, "!": 1}
    order = sorted(counts, key=lambda t: (-counts[t], t))
    assert got == {t: i for i, t in enumerate([*encode.SPECIAL_TOKENS, *order])}
    few = encode.build_vocab(df, min_count=2, max_words=1, max_alphabet=2)
    assert [r.token for r in few.orderBy("id").collect()][4:] == ["##a", "a", "aa"]


def test_vocabulary_limit_under_ties(corpus):
    df = corpus([(0, " ".join(f"w{i:03d}" for i in range(50)) + " zz zz")])
    got = encode.build_vocab(df, min_count=1, max_words=10, max_alphabet=0)
    assert [r.token for r in got.orderBy("id").collect()][4:] == ["zz"] + [f"w{i:03d}" for i in range(9)]


def test_limit_and_repeated_tokens_do_not_depend_on_the_way(spark, vocab):
    df = spark.createDataFrame([(1, ["unaffable", "the", "the"]), (2, []), (3, None)], "k INT, words ARRAY<STRING>")
    twice = vocab.unionByName(spark.createDataFrame([("the", 999)], "token STRING, id INT"))
    found = [
        {r.k: r.ids for r in encode.with_pieces(df, "k", twice, 1, limit=4, broadcast_bytes=n).collect()} for n in (0, 32 << 20)
    ]
    ids = {t: i for i, t in enumerate(TOKENS)}
    assert found[0] == found[1] == {1: [ids["un"], ids["##aff"], ids["##able"], ids["the"]], 2: [], 3: []}


def test_rare_letters_are_listed(corpus):
    df = corpus([(0, "".join(map(chr, range(0x4E00, 0x4E00 + 1200))))])
    assert encode.build_vocab(df).count() == 4 + 1200


def test_caller_tokenizer(corpus):
    def lengths(texts):
        return [([len(t), 0], [1, 0]) for t in texts]

    rows = encode.encode_with(corpus([(0, "abc"), (1, "")]), lengths, keep=("label",)).collect()
    assert sorted((r.doc_id, r.label, r.token_ids, r.attention_mask) for r in rows) == [
        (0, 0, [3, 0], [1, 0]), (1, 1, [0, 0], [1, 0]),
    ]


def test_truncation_report(corpus, vocab):
    df = corpus([(0, "the " * 127), (0, "the"), (1, "xxx " * 43), (1, "xxx " * 42)])
    encoded = encode.encode(df.withColumn("split", F.lit("train")), vocab, keep=("label", "split"))
    got = {r.label: r for r in encode.truncation_report(encoded).collect()}
    assert (got[0].n_truncated, got[1].n_truncated) == (1, 1)
    assert got[0].share_truncated == 0.5


def test_unmatched_ids(spark):
    left, right = spark.range(0, 5).withColumnRenamed("id", "doc_id"), spark.range(2, 7).withColumnRenamed("id", "doc_id")
    got = sorted((r.doc_id, r.missing_in) for r in join.unmatched(left, right).collect())
    assert got == [(0, "other"), (1, "other"), (5, "corpus"), (6, "corpus")]
