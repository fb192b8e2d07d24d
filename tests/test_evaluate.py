import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lectern.operators import evaluate

EPS = 1e-7


def by_hand(pairs, labels):
    """Precision, recall, F1 per label of (label, prediction) pairs, unrounded."""
    out = {}
    for c in labels:
        tp = sum(1 for a, p in pairs if a == p == c)
        precision = tp / (sum(p == c for _, p in pairs) + EPS)
        recall = tp / (sum(a == c for a, _ in pairs) + EPS)
        out[c] = (precision, recall, 2 * precision * recall / (precision + recall + EPS))
    return out


def batched(spark, pairs, size):
    rows = [(i, i, i // size, a, p) for i, (a, p) in enumerate(pairs)]
    schema = "doc_id BIGINT, position BIGINT, batch_id BIGINT, label INT, prediction INT"
    return spark.createDataFrame(rows, schema).repartition(3)


CASES = {
    "short last batch": ([(0, 0), (1, 0), (0, 1), (1, 1), (2, 0)], 2, [0, 1, 2]),
    "label never predicted": ([(0, 0), (2, 0), (1, 1), (2, 1)], 3, [0, 1, 2]),
    "label absent everywhere": ([(0, 0), (1, 1)], 2, [0, 1, 2, 3]),
    "all wrong": ([(0, 1), (1, 0), (0, 1)], 2, [0, 1]),
    "random": ([(random.Random(i).randint(0, 3), random.Random(-i).randint(0, 3)) for i in range(150)], 32, [0, 1, 2, 3]),
}


@pytest.mark.parametrize("name", CASES)
def test_batch_means(spark, name):
    pairs, size, labels = CASES[name]
    df = batched(spark, pairs, size)
    batches = [pairs[i: i + size] for i in range(0, len(pairs), size)]
    rounded = [{c: [round(v, 2) for v in m] for c, m in by_hand(b, labels).items()} for b in batches]
    per_batch = evaluate.batch_metrics(df, labels, size)
    got = {(r.batch_id, r.label): [r.precision, r.recall, r.f1] for r in per_batch.collect()}
    assert got == {(b, c): m for b, metrics in enumerate(rounded) for c, m in metrics.items()}
    table = evaluate.results_table(df, labels, size).collect()
    assert [r.label for r in table] == labels
    for row in table:
        want = [sum(m[row.label][k] for m in rounded) / len(batches) for k in range(3)]
        assert [row.precision, row.recall, row.f1] == pytest.approx(want)
    hits = [sum(a == p for a, p in b) / len(b) for b in batches]
    accuracy = evaluate.mean_accuracy(evaluate.batch_accuracy(df)).first()
    assert accuracy.accuracy == pytest.approx(sum(hits) / len(hits))
    assert accuracy.n_batches == len(batches)


@pytest.mark.parametrize("name", CASES)
def test_global_metrics(spark, name):
    pairs, size, labels = CASES[name]
    got = {r.label: r for r in evaluate.global_metrics(batched(spark, pairs, size), labels).collect()}
    for c, want in by_hand(pairs, labels).items():
        assert [got[c].precision, got[c].recall, got[c].f1] == pytest.approx(list(want))


def test_one_batch_of_all_rows_equals_global(spark):
    pairs, _, labels = CASES["random"]
    df = batched(spark, pairs, len(pairs))
    whole = {r.label: r for r in evaluate.global_metrics(df, labels).collect()}
    for row in evaluate.results_table(df, labels, len(pairs)).collect():
        for name in ("precision", "recall", "f1"):
            assert row[name] == round(whole[row.label][name], 2)


def test_global_metrics_agree_with_the_evaluator(spark):
    pairs, size, labels = CASES["random"]
    df = batched(spark, pairs, size).select(
        F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")
    ).cache()
    got = {r.label: r for r in evaluate.global_metrics(batched(spark, pairs, size), labels).collect()}
    for c in labels:
        for name, metric in (("precision", "precisionByLabel"), ("recall", "recallByLabel"), ("f1", "fMeasureByLabel")):
            check = MulticlassClassificationEvaluator(metricName=metric, metricLabel=float(c)).evaluate(df)
            assert got[c][name] == pytest.approx(check, abs=1e-6)


def test_error_rows(spark, corpus):
    df = corpus([(0, "a"), (1, "b"), (0, "c"), (1, "d")])
    guess = spark.createDataFrame(
        [(0, 0, 1), (1, 1, 1), (2, 0, 1), (3, 1, 0)], "doc_id BIGINT, label INT, prediction INT"
    )
    rows = evaluate.errors(df, guess).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, "a"), (2, 0, 1, "c"), (3, 1, 0, "d")]
    assert evaluate.errors(df, guess).columns == ["doc_id", "label", "prediction", "text"]
    assert sorted(r.doc_id for r in evaluate.errors(df, guess, first=2).collect()) == [0, 2]
    right = guess.withColumn("prediction", F.col("label"))
    assert evaluate.errors(df, right).count() == 0
    assert evaluate.with_predictions(df, guess).count() == 4
