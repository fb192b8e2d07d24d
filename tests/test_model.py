import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import bayes, evaluate, labels, linear, loss, profile

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    rows = []
    for _ in range(90):
        label = rng.choice([0, 0, 0, 1, 2])
        words = rng.choices(WORDS[label * 8: label * 8 + 14], k=rng.randint(1, 160))
        rows.append((label, " ".join(words)))
    return rows + [(1, "never seen"), (0, "")]


def by_hand(train, test, min_count=2):
    counts = {c: Counter() for c in {c for c, _ in train}}
    for c, text in train:
        counts[c].update(text.split())
    n_c = Counter(c for c, _ in train)
    mass = {c: (1 - n / len(train)) * n for c, n in n_c.items()}
    total = sum(counts.values(), Counter())
    vocab = {t for t, n in total.items() if n >= min_count}
    in_vocab = {c: sum(counts[c][t] for t in vocab) for c in counts}
    out = []
    for _, text in test:
        out.append([
            math.log(mass[c] / sum(mass.values()))
            + sum(math.log((counts[c][t] + 1) / (in_vocab[c] + len(vocab)))
                  for t in text.split() if t in vocab)
            for c in sorted(counts)
        ])
    return out


def logits_of(df):
    return [r.logits for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_scores_by_hand_for_every_row(corpus, pairs):
    train = pairs[:60]
    model = bayes.fit_counts(corpus(train))
    got = logits_of(bayes.score(corpus(pairs), bayes.scores_of(model)))
    assert len(got) == len(pairs)
    np.testing.assert_allclose(got, by_hand(train, pairs), atol=1e-6)
    # A row without a listed word keeps its priors.
    assert got[-1] == got[-2]


def test_resuming_equals_fitting_the_whole(spark, corpus, pairs, tmp_path):
    df = corpus(pairs)
    whole = bayes.fit_counts(df)
    path = str(tmp_path / "model")
    bayes.fit_counts(df.where("doc_id < 40")).write(path)
    resumed = bayes.fit_counts(df.where("doc_id >= 40"), prior=bayes.CountModel.read(spark, path))
    assert sorted(map(tuple, whole.tokens.collect())) == sorted(map(tuple, resumed.tokens.collect()))
    assert sorted(map(tuple, whole.labels.collect())) == sorted(map(tuple, resumed.labels.collect()))
    assert logits_of(bayes.score(df, bayes.scores_of(whole))) == logits_of(
        bayes.score(df, bayes.scores_of(resumed))
    )


@pytest.mark.parametrize("limit", [0, 900, 32 << 20])
def test_rows_of_classes_sum_to_the_same_scores(corpus, pairs, limit):
    scores = bayes.scores_of(bayes.fit_counts(corpus(pairs[:60])))
    found = bayes.score(corpus(pairs), scores, broadcast_bytes=limit, column_classes=0)
    want = bayes.score(corpus(pairs), scores, broadcast_bytes=limit)
    np.testing.assert_allclose(logits_of(found), logits_of(want), atol=2e-6)
    np.testing.assert_allclose(logits_of(found), by_hand(pairs[:60], pairs), atol=2e-6)


def test_no_listed_word(corpus):
    scores = bayes.scores_of(bayes.fit_counts(corpus([(0, "a"), (1, "b"), (1, "c")])))
    for classes in (0, 64):
        assert len({tuple(x) for x in logits_of(bayes.score(corpus([(0, "a b"), (1, ""), (1, None)]), scores, column_classes=classes))}) == 1


def test_five_thousand_classes(corpus):
    train = [(c, f"common own{c} own{c} near{c % 700}") for c in range(5_000)]
    train += [(c, "common common") for c in range(100)]
    scores = bayes.scores_of(bayes.fit_counts(corpus(train)))
    assert len(scores.classes) == 5_000
    test = [(c, f"own{c} own{c} common unheard") for c in range(0, 5_000, 500)] + [(3, "")]
    logits = bayes.score(corpus(test), scores)
    np.testing.assert_allclose(logits_of(logits), by_hand(train, test), atol=2e-6)
    predicted = {r.doc_id: (r.label, r.prediction) for r in evaluate.with_prediction(logits, scores.classes).collect()}
    assert sum(a == b for a, b in predicted.values()) >= 10
    rows = evaluate.with_prediction(logits, scores.classes).select(
        F.col("doc_id").alias("position"), F.lit(0).alias("batch_id"), "label", "prediction"
    )
    per_label = evaluate.batch_metrics(rows, scores.classes, 100).collect()
    assert len(per_label) == 5_000 and sum(r.tp for r in per_label) >= 10


@pytest.mark.parametrize("parts", [1, 7])
def test_layout_does_not_matter(corpus, pairs, parts):
    model = bayes.fit_counts(corpus(pairs))
    want = logits_of(bayes.score(corpus(pairs), bayes.scores_of(model)))
    model = bayes.fit_counts(corpus(pairs, parts))
    assert logits_of(bayes.score(corpus(pairs, parts), bayes.scores_of(model))) == want


def test_scores_with_a_shuffled_tail(corpus, pairs):
    scores = bayes.scores_of(bayes.fit_counts(corpus(pairs)))
    want = logits_of(bayes.score(corpus(pairs), scores))
    for limit in (0, 60, 300):
        np.testing.assert_allclose(logits_of(bayes.score(corpus(pairs), scores, broadcast_bytes=limit)), want, atol=2e-6)


def test_long_words_and_whole_texts_count(corpus):
    long = "x" * 300
    df = corpus([(0, f"{long} a " * 200), (1, "b b")])
    found = {(r.label, r.token): r.n for r in bayes.fit_counts(df).tokens.collect()}
    assert found == {(0, long): 200, (0, "a"): 200, (1, "b"): 2}


def test_labels_need_not_start_at_zero(corpus):
    df = corpus([(1, "a a b"), (1, "a b b"), (5, "c d d"), (5, "c c d")])
    scores = bayes.scores_of(bayes.fit_counts(df))
    rows = evaluate.with_prediction(bayes.score(df, scores), scores.classes)
    assert all(r.label == r.prediction for r in rows.collect())
    assert all(r.nll < 0.7 for r in loss.with_nll(rows, scores.classes).collect())


def test_rows_without_weight_or_score_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, [0.1, 0.2]), (1, 1, [0.3, 0.1])], "batch_id BIGINT, label INT, logits ARRAY<DOUBLE>")
    weights = spark.createDataFrame([(0, 0.5)], "label INT, weight DOUBLE")
    with pytest.raises(Exception, match="no weight for label 1"):
        loss.weighted_loss(df, weights).collect()
    with pytest.raises(Exception, match="no score for label 1"):
        loss.with_nll(df, [0, 2]).collect()


def test_class_weights(corpus):
    rows = profile.class_weights(corpus([(0, "a"), (0, "b"), (0, "c"), (1, "d")])).collect()
    assert {r.label: r.weight for r in rows} == {0: 0.25, 1: 0.75}


def test_one_class_cannot_be_scored(corpus):
    model = bayes.fit_counts(corpus([(0, "a"), (0, "b")]))
    with pytest.raises(ValueError, match="2 classes"):
        bayes.class_priors(model)


def test_weighted_loss(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(11, 3)) * 5
    logits[0] = [1000.0, 0.0, -1000.0]
    label = [2, *rng.integers(0, 3, 10).tolist()]
    weight = np.array([0.2, 0.5, 0.9])
    df = spark.createDataFrame(
        [(i, i // 4, label[i], logits[i].tolist()) for i in range(11)],
        "doc_id BIGINT, batch_id BIGINT, label INT, logits ARRAY<DOUBLE>",
    )
    weights = spark.createDataFrame(list(enumerate(weight.tolist())), "label INT, weight DOUBLE")
    got = {r.batch_id: r.loss for r in loss.weighted_loss(df, weights).collect()}
    top = logits.max(axis=1)
    nll = top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - logits[range(11), label]
    w = weight[label]
    want = [(w[s] * nll[s]).sum() / w[s].sum() for s in (slice(0, 4), slice(4, 8), slice(8, 11))]
    np.testing.assert_allclose([got[i] for i in range(3)], want)
    per_batch = loss.weighted_loss(df, weights)
    assert loss.epoch_loss(per_batch).first().loss == pytest.approx(np.mean(want))
    assert sorted(r.batch_id for r in loss.progress(per_batch, 2).collect()) == [0, 2]


def test_class_index(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "lang STRING")
    assert labels.class_values(df, "lang") == ["a", "b", "c"]
    classes = labels.class_table(df, "lang")
    assert sorted(map(tuple, classes.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    found = labels.with_class(df, "lang", classes).collect()
    assert sorted(((r.lang, r.label) for r in found), key=str) == [(None, None), ("a", 0), ("b", 1), ("b", 1), ("c", 2)][1:] + [(None, None)]


def test_any_number_of_classes(spark):
    df = spark.range(1500).selectExpr("id AS doc_id", "CAST(id AS INT) AS label")
    assert labels.class_table(df, "label", "place").where("label <> place").count() == 0


def test_linear_model_learns_and_reloads(corpus, pairs, tmp_path):
    from pyspark.ml import PipelineModel

    df = corpus(pairs)
    model = linear.fit_linear(df, profile.class_weights(df), n_features=256)
    got = linear.predict_linear(df, model)
    assert got.where("label = prediction").count() > 0.8 * len(pairs)
    model.write().overwrite().save(str(tmp_path / "lr"))
    again = linear.predict_linear(df, PipelineModel.load(str(tmp_path / "lr")))
    assert again.exceptAll(got).count() == 0


def test_linear_model_keeps_every_word(corpus):
    n = (1 << 17) + 1000
    text = ["".join(f"{c}{i} " for i in range(n)) for c in "ab"]
    df = corpus([(0, text[0]), (0, text[0]), (1, text[1]), (1, text[1])])
    weights = profile.class_weights(df)
    model = linear.fit_linear(df, weights, max_iter=3)
    assert len(model.stages[0].vocabulary) == 2 * n
    held_out = corpus([(k % 2, f"{'ab'[k % 2]}{i}") for k, i in enumerate(range(0, n, 5000))])
    assert linear.predict_linear(held_out, model).where("label <> prediction").count() == 0
    with pytest.raises(ValueError, match="words for 256 features"):
        linear.fit_linear(df, weights, n_features=256)


def test_predict(corpus, pairs):
    scored = bayes.score(corpus(pairs), bayes.scores_of(bayes.fit_counts(corpus(pairs))))
    got = {r.doc_id: r.prediction for r in evaluate.predict(scored).collect()}
    assert got == {r.doc_id: int(np.argmax(r.logits)) for r in scored.collect()}


def test_the_gradient_vanishes_at_the_optimum_only(spark, corpus, pairs):
    from lectern.operators.postings import postings
    from lectern.plans.shared import saved

    df = corpus(pairs)
    weights = profile.class_weights(df)
    rows = saved(postings(df), "postings")
    model = linear.fit_linear(df, weights, tol=1e-9)
    betas = saved(linear.coefficients(spark, model), "betas")
    found = linear.gradient_norms(rows, weights, betas).collect()
    assert sorted((r.label, r.n_rows) for r in found) == sorted(Counter(c for c, _ in pairs).items())
    assert all(r.norm < 1e-3 * r.start for r in found)
    moved = saved(betas.withColumn("betas", F.transform("betas", lambda b: b * 1.2)), "moved")
    assert all(r.norm > 5e-3 * r.start for r in linear.gradient_norms(rows, weights, moved).collect())
    # Without coefficients the gradient is the one at the start, found here by hand.
    zero = saved(betas.withColumn("betas", F.transform("betas", lambda b: b * 0)), "zero")
    at_zero = {r.label: r for r in linear.gradient_norms(rows, weights, zero).collect()}
    weight = {r.label: r.weight for r in weights.collect()}
    idf = {r.word: r.idf for r in betas.collect()}
    whole = sum(weight[c] for c, _ in pairs)
    features = [Counter({w: n * idf[w] for w, n in Counter(text.split()).items() if w in idf}) for _, text in pairs]
    squares = sum(weight[c] ** 2 for c, _ in pairs)
    scale = {None: 1.0}
    for word in idf:
        if word is not None:
            mean = sum(weight[c] * x[word] for (c, _), x in zip(pairs, features)) / whole
            scale[word] = math.sqrt(sum(weight[c] * (x[word] - mean) ** 2 for (c, _), x in zip(pairs, features)) / (whole - squares / whole))
    for k, row in at_zero.items():
        slope = Counter()
        for (c, _), row_features in zip(pairs, features):
            error = weight[c] / whole * (1 / len(weight) - (c == k))
            slope[None] += error
            for word, x in row_features.items():
                slope[word] += error * x
        by_hand = math.sqrt(sum((v / scale[word]) ** 2 for word, v in slope.items()))
        assert row.norm == pytest.approx(by_hand) == row.start


@pytest.mark.parametrize("block_pairs", [1 << 20, 400])
def test_linear_model_in_blocks_is_the_one_of_mllib(spark, corpus, pairs, block_pairs):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer

    from lectern.functions.text import words

    df = corpus(pairs)
    weights = profile.class_weights(df)
    rows = df.join(weights.select("label", "weight"), "label").select("label", "weight", words("text").alias("words"))
    stages = [
        CountVectorizer(inputCol="words", outputCol="counts", minDF=2),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(weightCol="weight", maxIter=500, tol=1e-12, regParam=linear.PENALTY, family="multinomial"),
    ]
    counter, idf, regression = Pipeline(stages=stages).fit(rows).stages
    model = linear.fit_linear(df, weights, tol=1e-8, block_pairs=block_pairs)
    found = {r.word: (r.idf, r.betas) for r in linear.coefficients(spark, model).collect()}
    assert found.keys() == {None, *counter.vocabulary}
    for i, word in enumerate(counter.vocabulary):
        assert found[word][0] == pytest.approx(idf.idf[i])
        np.testing.assert_allclose(found[word][1], regression.coefficientMatrix.toArray()[:, i], atol=1e-5)
    np.testing.assert_allclose(found[None][1], regression.interceptVector.toArray(), atol=1e-5)


def test_linear_fit_sends_few_numbers_to_the_driver(spark, corpus, tmp_path):
    import json
    import subprocess
    import sys

    # The event log of a session of its own tells the size of every task's result.
    n = 60_000
    code = f"""
import sys
sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.autoBroadcastJoinThreshold", "-1").config("spark.checkpoint.dir", "file://{tmp_path}/shared")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{tmp_path}")
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").getOrCreate())
from lectern.operators import linear, profile
# Tables that are broadcast, which are bounded, go by the driver as well.
linear.small_side = lambda df: df
text = ["".join(f"{{c}}{{i}} " for i in range({n})) for c in "ab"]
rows = [(i, i % 2, text[i % 2]) for i in range(4)]
df = spark.createDataFrame(rows, "doc_id BIGINT, label INT, text STRING").repartition(2)
model = linear.fit_linear(df, profile.class_weights(df), max_iter=3)
assert linear.predict_linear(df, model).where("label <> prediction").count() == 0
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    logs = [p for p in tmp_path.iterdir() if p.is_file() and p.name.startswith("local")]
    events = [json.loads(line) for p in logs for line in p.read_text().splitlines()]
    sizes = [e["Task Metrics"]["Result Size"] for e in events if e["Event"] == "SparkListenerTaskEnd"]
    # One number for each word alone would be 960,000 bytes.
    assert sizes and sum(max(0, size - 10_000) for size in sizes) < 500_000


@pytest.fixture(scope="module")
def shuffled(tmp_path_factory):
    """Records that fit, prediction and gradient shuffle, and the pairs of row and word."""
    import json
    import subprocess
    import sys

    # The event log of a session of its own tells what every task wrote.
    tmp_path = tmp_path_factory.mktemp("shuffled")
    code = f"""
import sys
sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.autoBroadcastJoinThreshold", "-1").config("spark.checkpoint.dir", "file://{tmp_path}/shared")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{tmp_path}")
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").getOrCreate())
from lectern.operators import linear, profile
from lectern.operators.postings import postings
from lectern.plans.shared import saved
# As for tables too large for a broadcast.
linear.small_side = lambda df: df
rows = [(i, i % 2, " ".join(f"w{{(i * j + j) % 499}}" for j in range(1, 400))) for i in range(400)]
df = saved(spark.createDataFrame(rows, "doc_id BIGINT, label INT, text STRING").repartition(2), "texts")
words, weights = saved(postings(df), "postings"), saved(profile.class_weights(df), "weights")
print(words.count())
spark.sparkContext.setJobDescription("fit")
model = linear.fit_linear(df, weights, max_iter=2)
spark.sparkContext.setJobDescription("predict")
linear.predict_linear(df, model).collect()
spark.sparkContext.setJobDescription("gradient")
linear.gradient_norms(words, weights, linear.coefficients(spark, model)).collect()
spark.stop()
"""
    said = subprocess.run([sys.executable, "-c", code], check=True, timeout=300, stdout=subprocess.PIPE, text=True).stdout
    logs = [p for p in tmp_path.iterdir() if p.is_file() and p.name.startswith("local")]
    events = [json.loads(line) for p in logs for line in p.read_text().splitlines()]
    step = {s: e["Properties"].get("spark.job.description") for e in events if e["Event"] == "SparkListenerJobStart" for s in e["Stage IDs"]}
    records = Counter()
    for e in events:
        if e["Event"] == "SparkListenerTaskEnd":
            records[step[e["Stage ID"]]] += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Records Written"]
    return records, int(said.split()[-1])


@pytest.mark.parametrize("step", ["fit", "predict", "gradient"])
def test_rows_of_the_linear_model_meet_their_words_without_a_shuffle_of_pairs(shuffled, step):
    records, n_pairs = shuffled
    assert 0 < records[step] < n_pairs / 10


def test_linear_fit_of_texts_of_very_different_lengths_takes_few_rounds(spark, corpus):
    from lectern.operators.postings import postings
    from lectern.plans.shared import saved

    rng = np.random.default_rng(5)
    pairs = []
    for i in range(300):
        label = int(rng.integers(3))
        n = int(rng.choice([3, 10, 40, 3000], p=[0.4, 0.3, 0.2, 0.1]))
        found = np.where(rng.random(n) < 0.3, 1000 * label, 0) + rng.zipf(1.3, n) % 1000
        pairs.append((label, " ".join(f"w{x}" for x in found)))
    df = corpus(pairs)
    weights = profile.class_weights(df)
    model = linear.fit_linear(df, weights, max_iter=12)
    betas = saved(linear.coefficients(spark, model), "betas")
    found = linear.gradient_norms(saved(postings(df), "postings"), weights, betas).collect()
    assert len(found) == 3 and all(r.norm < 1e-4 * r.start for r in found)


def test_a_seed_tells_all_words_apart(spark):
    from lectern.operators import blocks

    words = spark.createDataFrame([(w,) for w in ("a", "b", "c")], "word STRING")
    assert blocks.seed_of(words) == 0
    # Keys that are the same under the first seeds.
    assert blocks.seed_of(words, lambda word, seed: F.when(F.lit(seed < 2), F.lit(7)).otherwise(F.ascii(word))) == 2
