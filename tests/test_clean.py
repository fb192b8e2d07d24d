import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import clean, profile
from lectern.plans import shared


def by_pandas(pairs, min_tokens=6):
    """What the cleaning must keep, computed the plain way."""
    frame = pd.DataFrame(pairs, columns=["label", "text"])
    frame["text"] = frame["text"].fillna("").str.strip()
    frame = frame[frame["text"] != ""]
    copies = frame[frame.duplicated()]
    kept = frame.drop_duplicates()
    lengths = kept["text"].str.split().str.len()
    return frame, copies, kept, kept[~lengths.between(1, min_tokens - 1)]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    rows = [(rng.randint(0, 2), rng.choice(texts)) for _ in range(300)]
    rows += [(0, "one hot text that is copied again and again")] * 150
    rows += [(0, " a b "), (1, "a b"), (0, "a b"), (0, None), (1, ""), (2, " \t "), (0, "NA")]
    rng.shuffle(rows)
    return rows


def test_cleaning_matches_pandas(corpus, pairs):
    frame, copies, kept, final = by_pandas(pairs)
    df = corpus(pairs)
    assert ids(clean.drop_empty(df)) == sorted(frame.index)
    assert ids(clean.duplicate_rows(df)) == sorted(copies.index)
    assert ids(clean.drop_duplicates(df)) == sorted(kept.index)
    cleaned = clean.clean(df)
    assert ids(cleaned) == sorted(final.index)
    assert all(r.n_tokens == len(r.text.split()) for r in cleaned.collect())


def test_empty_rows(corpus):
    df = corpus([(0, None), (0, ""), (0, " "), (0, "\t\n"), (0, " "), (0, "NA"), (0, "x")])
    assert ids(clean.empty_rows(df)) == [0, 1, 2, 3, 4]
    assert ids(clean.drop_empty(df)) == [5, 6]


@pytest.mark.parametrize("broadcast, hashed", [(0, 0), (0, 10**9), (10**6, 0)])
def test_every_join_strategy_keeps_the_same_rows(corpus, pairs, monkeypatch, broadcast, hashed):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(shared, "HASH_ROWS_PER_PARTITION", hashed)
    assert ids(clean.clean(corpus(pairs))) == sorted(by_pandas(pairs)[3].index)


def test_clean_keys_are_those_of_the_cleaned_rows(corpus, pairs):
    rows, keys = clean.clean_with_keys(corpus(pairs))
    assert sorted(map(tuple, keys.collect())) == sorted((r.doc_id, r.label) for r in rows.collect())
    assert ids(rows) == sorted(by_pandas(pairs)[3].index)


def test_lengths_6_and_up_are_kept(corpus):
    df = corpus([(0, " ".join("x" * n)) for n in range(9)])
    assert ids(clean.drop_short(clean.drop_empty(df))) == [6, 7, 8]
    assert ids(profile.rows_by_length(df, 0, 7)) == [1, 2, 3, 4, 5, 6, 7]
    assert {r.n_tokens: r.n_rows for r in profile.count_by_length(df, 2, 4).collect()} == {2: 1, 3: 1, 4: 1}


def test_first_rows_per_length(corpus, pairs):
    got = profile.rows_by_length(corpus(pairs), 0, 7, first=2).collect()
    kept = by_pandas(pairs)[2]
    lengths = kept["text"].str.split().str.len()
    want = [i for n in range(8) for i in sorted(lengths[lengths == n].index)[:2]]
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_profile_counts(corpus, pairs):
    frame, _, kept, final = by_pandas(pairs)
    got = {r.label: r for r in profile.class_profile(corpus(pairs)).collect()}
    for label in (0, 1, 2):
        assert got[label].n_raw == (frame["label"] == label).sum()
        assert got[label].n_distinct == (kept["label"] == label).sum()
        assert got[label].n_clean == (final["label"] == label).sum()
        assert got[label].weight == pytest.approx(1 - (final["label"] == label).mean())
    histogram = profile.length_histogram(corpus(pairs)).collect()
    want = kept["text"].str.split().str.len().value_counts()
    assert {r.n_tokens: r.n_rows for r in histogram} == want.to_dict()
    assert [r.n_rows for r in histogram] == sorted(want, reverse=True)


def test_first_longest_and_shortest_row_win(corpus):
    df = corpus([(0, "a b c"), (1, "a"), (0, "x y z"), (0, "b"), (2, "a b c")])
    assert profile.longest_row(df).first().doc_id == 0
    assert profile.shortest_row(df).first().doc_id == 1


def test_top_duplicates_in_text_order(corpus):
    df = corpus([(0, "b"), (0, "a"), (0, "b"), (0, "a"), (0, "a"), (1, "a")])
    assert [r.doc_id for r in profile.top_duplicates(df, 2).collect()] == [3, 4]


def test_summary(corpus):
    rows = profile.table_summary(corpus([(0, "a"), (None, None), (1, "b")])).collect()
    assert [(r.column_name, r.type, r.n_rows, r.n_non_null) for r in rows] == [
        ("doc_id", "bigint", 3, 3), ("label", "int", 3, 2), ("text", "string", 3, 2),
    ]


def test_copies_and_kept_rows_add_up(spark, corpus, pairs):
    df = corpus(pairs)
    groups = profile.distinct_texts(df)
    assert groups.agg(F.sum("n_copies")).first()[0] == clean.drop_empty(df).count()
    assert groups.count() + clean.duplicate_rows(df).count() == clean.drop_empty(df).count()
