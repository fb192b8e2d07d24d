import random
from collections import Counter

import pytest

from lectern.operators import bayes, encode, postings
from lectern.plans import shared

FIRST = 126


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    words = ["the", "cat", "Élan", "日", "x" * 120, "a", "."] + [f"w{i}" for i in range(60)]
    rows = [(rng.randint(0, 2), " ".join(rng.choices(words, k=rng.randint(0, 400)))) for _ in range(60)]
    return rows + [(0, ""), (1, None), (2, " \t")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows(corpus, pairs):
    df = corpus(pairs)
    found = postings.postings(df, first=FIRST).collect()
    by_row = {}
    for r in found:
        by_row.setdefault(r.doc_id, []).append(r)
    cut = {r.doc_id: r.words for r in encode_words(df)}
    assert set(by_row) == set(cut)
    for doc, words in cut.items():
        assert {r.word: r.n for r in by_row[doc]} == (dict(Counter(words)) or {None: 0})
        assert {r.n_words for r in by_row[doc]} == {len(words)}
    early = postings.early_words(postings.postings(df, first=FIRST), ("label",), 40).collect()
    places = {}
    for r in early:
        places.setdefault(r.doc_id, []).append((r.at_word, r.word))
    for doc, words in cut.items():
        assert sorted(places[doc], key=repr) == sorted((list(enumerate(words[:40])) or [(None, None)]), key=repr)


def encode_words(df):
    from lectern.functions.text import words

    return df.select("doc_id", words("text").alias("words")).collect()


@pytest.mark.parametrize("max_len", [8, 65, 128])
def test_the_same_from_postings_as_from_texts(corpus, pairs, max_len):
    df = corpus(pairs)
    cut = shared.saved(postings.postings(df, first=FIRST), "cut")
    vocab = encode.build_vocab(df)
    assert sorted(map(tuple, encode.build_vocab(cut).collect())) == sorted(map(tuple, vocab.collect()))
    whole = encode.encode(df, vocab, max_len, keep=("label",))
    again = encode.encode(cut, vocab, max_len, keep=("label",))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    model, from_cut = bayes.fit_counts(df), bayes.fit_counts(cut)
    for a, b in ((model.tokens, from_cut.tokens), (model.labels, from_cut.labels)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    scores = bayes.scores_of(model)
    for limit in (0, 2000, 32 << 20):
        want = sorted(map(tuple, bayes.score(df, scores, broadcast_bytes=limit).collect()))
        assert sorted(map(tuple, bayes.score(cut, scores, broadcast_bytes=limit).collect())) == want


def test_texts_are_cut_once(corpus, pairs):
    """Nothing that reads postings, and no score of texts, cuts words in its own plan."""
    df = corpus(pairs)
    cut = shared.saved(postings.postings(df), "cut")
    scores = bayes.scores_of(bayes.fit_counts(cut))
    for plan in (bayes.fit_counts(cut).tokens, bayes.score(cut, scores), bayes.score(df, scores, broadcast_bytes=100), encode.encode(cut, encode.build_vocab(cut))):
        assert "regexp_extract_all" not in plan_of(plan)


def test_too_few_places_are_an_error(corpus, pairs):
    cut = postings.postings(corpus(pairs), first=63)
    with pytest.raises(Exception, match="too few first places"):
        postings.early_words(cut, ("label",), 126).collect()


def test_only_lengths_that_occur_are_looked_up(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["a", "ab", "abc", "abcdefgh", "abd", "##x", "##xyz", "##", "é日"])], "token string, id int")
    found = {(r.continues, r.lead): r.sizes for r in encode.token_lengths(vocab).collect()}
    assert found == {
        (False, "a"): [1], (False, "ab"): [2], (False, "abc"): [3, 8], (False, "abd"): [3], (False, "##x"): [3, 5],
        (False, "##"): [2], (False, "é日"): [2], (True, "x"): [1], (True, "xyz"): [3],
    }


def test_sides_are_measured_in_bytes(spark):
    long = shared.saved(spark.createDataFrame([("x" * 5_000_000, 1), ("y" * 5_000_000, 2)], "word string, id int"), "long")
    assert shared.table_bytes(long) > 10_000_000
    plan = spark.range(5).selectExpr("string(id) AS word").join(shared.small_side(long, 1 << 20), "word")
    assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()
    short = shared.saved(spark.createDataFrame([("x", 1)], "word string, id int"), "short")
    assert "broadcast" in spark.range(5).selectExpr("string(id) AS word").join(shared.small_side(short), "word")._jdf.queryExecution().analyzed().toString()
    lists = shared.saved(spark.createDataFrame([(["a" * 100] * 50, [1] * 10, None)], "a array<string>, b array<int>, c string"), "lists")
    assert 5000 < shared.table_bytes(lists) < 6000
    assert shared.table_bytes(short.where("id > 1")) == 0


def test_spread(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1000).selectExpr("id", "string(id) AS text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    dealt = shared.spread(df)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, df.collect()))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in dealt.where("id = 7")._jdf.queryExecution().executedPlan().toString()
    wide = spark.range(0, 1000, 1, 64)
    assert shared.spread(wide).rdd.getNumPartitions() == 64


def test_words_are_counted_without_a_shuffle(corpus, pairs):
    found = postings.postings(corpus(pairs), first=FIRST)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    # The rows of a text stay together, so that sums by text are done in the map tasks.
    at = [r.doc_id for r in found.collect()]
    assert len(set(at)) == 1 + sum(a != b for a, b in zip(at, at[1:]))


def test_rows_beyond_a_block_of_words():
    import pyarrow as pa

    texts = [["a", "b", "a"], [], ["b"] * 200, ["c"]]
    row, n_words, word, n, early = postings._counted(pa.array(texts, pa.list_(pa.string())), range(0, FIRST, 63), FIRST)
    assert list(zip(row.tolist(), n_words.tolist(), word.to_pylist(), n.tolist())) == [
        (0, 3, "a", 2), (0, 3, "b", 1), (1, 0, None, 0), (2, 200, "b", 200), (3, 1, "c", 1)
    ]
    assert early.tolist() == [[5, 0], [2, 0], [0, 0], [2**63 - 1, 2**63 - 1], [1, 0]]


def test_a_written_part_needs_no_sort(spark, tmp_path):
    from lectern.sources.tables import write_table

    rows = [(i, ("train", "valid", "test")[i % 3]) for i in range(60)]
    write_table(spark.createDataFrame(rows, "doc_id bigint, split string").coalesce(1), str(tmp_path / "t"), "split")
    # Rows of a part keep the order in which the task had them, and the setting is undone.
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == sorted(rows)


def test_a_word_meets_its_pieces_once_a_row(spark):
    early = [[5, 0], [0, 1 << 62], [1 << 62, 7], [2**63 - 1, 2**63 - 1]]
    rows = spark.createDataFrame([(i, "w", e) for i, e in enumerate(early)], "doc_id bigint, word string, early array<bigint>")
    wanted = [[b + 63 * i for i, bits in enumerate(e) for b in range(63) if bits >> b & 1] for e in early]
    for limit in (1, 63, 64, 100, 126):
        found = postings.reached_words(rows, (), limit)
        at = {r.doc_id: r.at for r in found.select("doc_id", postings.places_of(found.at_word).alias("at")).collect()}
        assert at == {i: kept for i, w in enumerate(wanted) if (kept := [p for p in w if p < limit])}
