import random

import pytest

from lectern.operators import encode
from lectern.plans import workflow
from lectern.sources import runs


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    return [
        (label, " ".join(rng.choices(words[label * 10: label * 10 + 20], k=rng.randint(4, 60))))
        for label in rng.choices([0, 1, 2], [6, 3, 2], k=160)
    ]


def test_prepare_train_test_and_go_on(spark, corpus, pairs, tmp_path):
    folder = str(tmp_path / "run")
    workflow.prepare(corpus(pairs), folder)
    rows = spark.read.parquet(f"{folder}/corpus")
    counts = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    kept = len({p for p in pairs if len(p[1].split()) > 5})
    assert sum(counts.values()) == kept and counts["test"] == -(-kept // 5)
    encoded = spark.read.parquet(f"{folder}/encoded")
    assert sorted(encoded.select("doc_id", "label", "split").collect()) == sorted(
        rows.select("doc_id", "label", "split").collect()
    )
    model = workflow.train(spark, folder, "r")
    result = workflow.test(spark, folder)
    assert [r.label for r in result["results"].collect()] == [0, 1, 2]
    assert result["accuracy"].first().accuracy > 0.6
    wrong = result["errors"].collect()
    assert len(wrong) == result["predictions"].where("label <> prediction").count()
    workflow.train(spark, folder, "r", epoch=1)
    once, twice = model.tokens.groupBy().sum("n").first()[0], None
    twice = workflow.bayes.CountModel.read(spark, f"{folder}/model/epoch-1").tokens.groupBy().sum("n").first()[0]
    assert twice == 2 * once
    recorded = runs.read_metrics(spark, f"{folder}/run_metrics").collect()
    assert {(r.epoch, r.subset, r.name) for r in recorded} == {
        (e, s, n) for e in (0, 1) for s in ("train", "valid")
        for n in ["loss", "accuracy"] + [f"{m}/{c}" for m in ("precision", "recall", "f1") for c in range(3)]
    }
    # Training an epoch again replaces its records.
    workflow.train(spark, folder, "r", epoch=1)
    assert runs.read_metrics(spark, f"{folder}/run_metrics").count() == len(recorded)
    assert {r.name for r in runs.read_params(spark, f"{folder}/run_params").collect()} == {
        "num_epochs", "num_classes", "batch_size", "seed", "model_path"
    }
    # Preparing again leaves the same rows.
    before = sorted(rows.select("doc_id", "split").collect())
    workflow.prepare(corpus(pairs), folder)
    assert sorted(spark.read.parquet(f"{folder}/corpus").select("doc_id", "split").collect()) == before


@pytest.mark.parametrize("linear_model", [False, True])
def test_labels_of_any_type(spark, corpus, pairs, tmp_path, linear_model):
    names = {0: "sport", 1: "economy", 2: "world"}
    rows = [(i, names[label], text) for i, (label, text) in enumerate(pairs)]
    folder = str(tmp_path / f"names-{linear_model}")
    workflow.prepare(spark.createDataFrame(rows, "doc_id BIGINT, label STRING, text STRING"), folder)
    workflow.train(spark, folder, "r", linear_model=linear_model)
    result = workflow.test(spark, folder, linear_model=linear_model)
    assert [r["class"] for r in result["results"].collect()] == sorted(names.values())
    assert result["accuracy"].first().accuracy > 0.6
    for r in result["predictions"].collect():
        assert r["class"] == rows[r.doc_id][1] and (r["class"] == r.predicted_class) == (r.label == r.prediction)
    assert all(r["class"] != r.predicted_class for r in result["errors"].collect())


def test_rows_without_label_are_refused(spark, tmp_path):
    rows = [(i, None if i == 3 else i % 2, f"a b c d e f {i}") for i in range(20)]
    with pytest.raises(ValueError, match="1 rows have no label"):
        workflow.prepare(spark.createDataFrame(rows, "doc_id BIGINT, label INT, text STRING"), str(tmp_path / "n"))


def test_supplied_vocabulary_brings_its_marker_ids(spark, corpus, pairs, tmp_path):
    tokens = ["[PAD]", "x", "[UNK]", "[CLS]", "[SEP]"] + [f"w{i}" for i in range(40)]
    vocab = spark.createDataFrame([(t, 10 + i) for i, t in enumerate(tokens)], "token STRING, id INT")
    workflow.prepare(corpus(pairs), str(tmp_path / "v"), vocab=vocab, max_len=16)
    for row in spark.read.parquet(str(tmp_path / "v" / "encoded")).collect():
        assert len(row.token_ids) == 16 and row.token_ids[0] == 13
        assert 14 in row.token_ids and 12 not in row.token_ids
        assert sum(row.attention_mask) == min(row.n_words, 14) + 2
    assert encode.special_ids(vocab) == encode.Specials(10, 12, 13, 14)


def test_the_linear_model_cannot_be_trained_further(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="cannot be trained further"):
        workflow.train(spark, str(tmp_path), "r", epoch=1, linear_model=True)
