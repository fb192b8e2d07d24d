import zlib

import numpy as np
import pyarrow as pa
import pytest
from plain import docs_of, edge_rows
from pyspark.sql import functions as F

from lectern.llm import boost, crf, langid, pseudo, queries, sample
from lectern.llm.vectors import add_up
from lectern.llm.words import NOT_SPACE, hashed_words
from lectern.plans.shared import saved

SF01 = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = queries.op7_language(spark, SF01).toPandas()
    lang = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(lang, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    out = both[both.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.98
    assert both.score.between(0, 1).all()


def test_language_edges(spark):
    learn = spark.createDataFrame(
        [("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "und"), ("fr", None), ("en", "")], "lang string, text string"
    )
    model = langid.fit(learn)
    assert model.languages == ("en", "fr")
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "le chien et le chat"), (5, "The DOG and the cat"), (5, "The DOG and the cat"), (None, "the dog")]
    found = langid.identify(docs_of(spark, rows), model, "language").select("doc_id", "language.*").collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in found) == [
        ("1", "und"), ("2", "und"), ("3", "und"), ("4", "fr"), ("5", "en"), ("5", "en"), ("None", "en")
    ]
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    nothing = langid.fit(learn.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(docs_of(spark, rows), nothing).select("language.*").collect()} == {"und"}
    assert langid.identify(docs_of(spark, []), model).count() == 0


def test_language_of_pieces_equals_the_whole(monkeypatch):
    texts = pa.array(["le chat et le chien " * 40, "", "the dog " * 100, "ñ"])
    model = langid.LanguageModel(("a", "b"), np.zeros(2), np.random.default_rng(0).normal(size=(len(langid.ORDERS) << 8, 2)).astype("f"), 8)
    whole = langid.scores(texts, model)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert np.allclose(langid.scores(texts, model), whole)


def test_quality_on_held_out_documents(spark):
    found = queries.op8_quality(spark, SF01).toPandas()
    flags = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    both = found.merge(flags, on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.quality).mean() > 0.95
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()


def test_quality_edges(spark):
    rows = edge_rows()
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(7, 1), (8, 1), (8, 0), (20, 0), (21, None), (None, 1), (99, 1)], "doc_id bigint, label int")
    scored = crf.quality(docs, crf.fit(docs, labels)).select("doc_id", "text", "quality").collect()
    assert len(scored) == len(rows) and all(0 <= r.quality <= 1 for r in scored)
    same = {r.quality for r in scored if r.text in (None, "")}
    assert len(same) == 1
    empty = crf.fit(docs, labels.where("doc_id = 12345"))
    assert crf.quality(docs_of(spark, []), empty).count() == 0


def test_lines_of_texts():
    texts = ["a b\n\nC.\n", "", "x", "\n", "no end\nlast"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.r_[0, np.cumsum([len(r) for r in raw])]
    x, length, first = crf.line_features(data, starts)
    want = [[3, 0, 2], [0], [1], [0], [6, 4]]
    assert [length[a:b].tolist() for a, b in zip(first, first[1:])] == want
    alone, _, _ = crf.line_features(np.frombuffer(raw[4], np.uint8), np.array([0, len(raw[4])]))
    assert np.allclose(x[-2:], alone)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    u, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4 + 1, 9])
    p, _, _ = crf.marginals(u, moves, crf.Chains(first))
    for a, b in zip(first, first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for bits in range(2 ** (b - a)):
            y = [(bits >> k) & 1 for k in range(b - a)]
            w = np.exp(sum(u[a + k] * y[k] for k in range(b - a)) + sum(moves[y[k - 1], y[k]] for k in range(1, b - a)))
            total += w
            good += w * np.array(y)
        assert np.allclose(p[a:b], good / total)


def test_network_learns_and_scores_whole_texts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    start = pseudo.start_network(saved(pseudo.word_counts(docs), "counts"))
    trained = pseudo.fit(docs)
    mean = lambda net: pseudo.score(docs, net).agg(F.sum("lm.log_prob") / F.sum("lm.n_tokens")).first()[0]
    assert mean(trained) > mean(start) + 0.05
    found = {r.doc_id: r for r in pseudo.score(docs, trained).select("doc_id", "text", "lm.*").collect()}
    assert all(r.n_tokens == len(r.text.split()) for r in found.values())


def test_network_probabilities_sum_to_one_and_step_uphill():
    rng = np.random.default_rng(0)
    counts = np.ones((pseudo.CLASSES, pseudo.IN_CLASS))
    net = pseudo.Network(
        np.zeros(0, np.uint64), np.zeros(0, np.int64), rng.normal(size=(pseudo.VOCABULARY + 1, pseudo.EMBED)).astype("f"),
        rng.normal(size=(len(pseudo.OFFSETS) * pseudo.EMBED, pseudo.HIDDEN)).astype("f") / 6, np.zeros(pseudo.HIDDEN, "f"),
        rng.normal(size=(pseudo.HIDDEN, pseudo.CLASSES)).astype("f"), np.log(counts.sum(1) / counts.sum()).astype("f"),
        rng.normal(size=(pseudo.CLASSES, pseudo.HIDDEN, pseudo.IN_CLASS)).astype("f"), np.zeros((pseudo.CLASSES, pseudo.IN_CLASS), "f"),
    )
    window = np.tile(rng.integers(0, pseudo.VOCABULARY, 4), (pseudo.VOCABULARY, 1))
    every = pseudo.log_probabilities(net, window, np.arange(pseudo.VOCABULARY))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    ids = rng.integers(0, 50, 2000)
    around = pseudo.contexts(ids, np.array([0, 700, 700, 2000]))
    assert (around[699, 2:] == pseudo.PAD).all() and (around[700, :2] == pseudo.PAD).all()
    before = pseudo.log_probabilities(net, around, ids).mean()
    pseudo.train(net, around, ids, 0.5)
    assert pseudo.log_probabilities(net, around, ids).mean() > before


def test_score_of_whole_texts_equals_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    net = pseudo.fit(docs)
    counts = {r.word: r.n for r in net.counts.collect()}
    embed, inner, to_class, to_word = (getattr(net, p).astype(float) for p in ("embed", "inner", "to_class", "to_word"))
    places = dict(zip(net.words.tolist(), net.places.tolist()))
    own = pseudo.VOCABULARY - pseudo.SHARED
    slots = np.zeros(pseudo.SHARED)
    for w, n in counts.items():
        if w % (1 << 64) not in places:
            slots[(w % (1 << 64) >> 40) % pseudo.SHARED] += n + 1

    def softmax(z):
        return np.exp(z) / np.exp(z).sum()

    for r in pseudo.score(docs, net).select("text", "lm.log_prob").collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        hashes = hashed_words(raw, np.array([0, len(raw)]), NOT_SPACE)[2].tolist()
        ids = [places.get(h, own + (h >> 40) % pseudo.SHARED) for h in hashes]
        total = 0.0
        for i, (h, y) in enumerate(zip(hashes, ids)):
            window = [ids[i + o] if 0 <= i + o < len(ids) else pseudo.PAD for o in (-2, -1, 1, 2)]
            hidden = np.tanh(np.concatenate([embed[w] for w in window]) @ inner + net.inner_bias)
            c, place = divmod(y, pseudo.IN_CLASS)
            p = softmax(hidden @ to_class + net.class_bias)[c] * softmax(hidden @ to_word[c] + net.word_bias[c])[place]
            if y >= own:
                p *= (counts[h - (1 << 64) if h >> 63 else h] + 1) / (slots[y - own] + 1)
            total += np.log(p)
        assert np.isclose(r.log_prob, total, rtol=1e-4, atol=1e-3)


def test_large_logits_neither_overflow_nor_vanish():
    rng = np.random.default_rng(3)
    z = (rng.normal(size=(50, pseudo.IN_CLASS)) * 200).astype("f")
    at = rng.integers(0, pseudo.IN_CLASS, 50)
    exact = z.astype(float)
    want = exact[np.arange(50), at] - exact.max(1) - np.log(np.exp(exact - exact.max(1, keepdims=True)).sum(1))
    found = pseudo._log_softmax_at(z, at, 1e4, np.ones(pseudo.IN_CLASS, "f"))
    assert np.isfinite(found).all() and np.allclose(found, want, rtol=1e-4, atol=1e-3)


def test_vectors_add_up_over_many_parts(spark):
    rows = [(f"k{i % 2}", i // 2, np.array([i, 1.0]).tobytes()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "key string, part bigint, vector binary").repartition(5)
    found = {r.key: np.frombuffer(r.vector).tolist() for r in add_up(vectors, fan_in=3).collect()}
    assert found == {"k0": [sum(range(0, 400, 2)), 200.0], "k1": [sum(range(1, 400, 2)), 200.0]}
    assert add_up(vectors.where("key = 'none'"), fan_in=3).count() == 0


def test_sample_of_repeated_labels_keeps_its_size(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").selectExpr("doc_id", "quality AS label")
    once, often = crf.fit(docs, labels, 100), crf.fit(docs, labels.crossJoin(spark.range(9)).drop("id"), 100)
    assert np.array_equal(once.mean, often.mean) and np.allclose(once.weights, often.weights)


def test_too_many_languages_are_an_error(spark):
    rows = spark.range(400).selectExpr("concat('l', id) AS lang", "'some text' AS text")
    with pytest.raises(ValueError, match="400 languages"):
        langid.fit(rows)
    assert len(langid.fit(rows, bits=8).languages) == 400


def test_network_edges(spark):
    rows = edge_rows()
    docs = docs_of(spark, rows)
    net = pseudo.fit(docs)
    found = pseudo.score(docs, net).select("text", "lm.*").collect()
    assert len(found) == len(rows)
    for r in found:
        n = len((r.text or "").split())
        assert r.n_tokens == n and (r.mean_log_prob is None) == (n == 0) and (n or r.log_prob == 0)
    none = docs_of(spark, [])
    assert pseudo.score(none, pseudo.fit(none)).count() == 0


def test_words_of_shared_places_have_their_share(spark):
    common = " ".join(f"c{i} " * 9 for i in range(pseudo.VOCABULARY - pseudo.SHARED))
    rare = [f"r{i}" for i in range(9000)]
    rows = [(1, common), (2, " ".join(rare)), (3, "r5 r5"), (3, "r5 r5"), (None, "r6 c1"), (None, "r6 c1"), (None, "r7"), (4, None)]
    net = pseudo.start_network(saved(pseudo.word_counts(docs_of(spark, rows)), "counts"))
    assert net.slots[:, 1].sum() == 9000 and net.slots[:, 0].sum() == 9000 + 4 + 3
    every = np.repeat(np.arange(pseudo.SHARED) + pseudo.VOCABULARY - pseudo.SHARED, 2)
    one, unseen = net.log_shares(every, np.tile([1.0, 0.0], pseudo.SHARED)).reshape(-1, 2).T
    assert np.all(unseen < one) and np.all(np.exp(unseen) < 0.5)
    asked = rows + [(10 + i, f"{w} {w}") for i, w in enumerate(["r5", "r8", "never-seen", "c1"])]
    held = pseudo.score(docs_of(spark, asked), net).select("doc_id", "text", "lm.*").collect()
    tail = pseudo.score(docs_of(spark, asked), net, held_bytes=0).select("doc_id", "text", "lm.*").collect()
    order = lambda found: sorted((str(r.doc_id), str(r.text), r.n_tokens, r.mean_log_prob or 0) for r in found)
    assert len(held) == len(tail) == len(asked)
    for a, b in zip(order(held), order(tail)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9
    base = lambda w: np.exp([r.mean_log_prob for r in held if r.text == f"{w} {w}"][0])
    # 9,000 words share 1,024 places: a single word has far less than its place.
    assert base("never-seen") < base("r8") < base("c1") / 3


def test_samples_are_bounded_and_stable(spark):
    table = spark.range(20_000).withColumnRenamed("id", "k")
    ids = [r.k for r in sample.least_hashes(table, "k", 500, 20_000).collect()]
    assert len(set(ids)) == 500
    assert ids == [r.k for r in sample.least_hashes(table.repartition(7), "k", 500, 20_000).collect()]
    assert sample.least_hashes(table, "k", 30_000, 20_000).count() == 20_000


def test_trees_fit_an_exclusive_or():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boost.calibrate(boost.fit(x[:1500], y[:1500]), x[1500:], y[1500:])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
