"""The three steps a user runs: prepare a corpus, train on it, test the model.

Steps hand over Parquet tables under one folder: ``classes``, ``corpus``, its ``words`` and
``encoded`` (the three partitioned by split), ``vocab``, and one model folder per epoch.
Texts are cut into words once; vocabulary, encoding and the count model read ``words``.
Rerunning a step overwrites its tables and records.
"""

import math

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import (
    bayes, clean, encode, evaluate, labels, linear, loss, postings, profile, rank, split,
)
from lectern.plans.shared import saved
from lectern.sources import runs
from lectern.sources.tables import read_split, write_table

# The published run's batch size and training seed.
BATCH_SIZE = 32
TRAIN_SEED = 7


def prepare(
    corpus: DataFrame,
    folder: str,
    vocab: DataFrame | None = None,
    max_len: int = encode.MAX_LEN,
    min_tokens: int = clean.MIN_TOKENS,
) -> None:
    """Clean ``doc_id, label, text``, split it 64/16/20 by class, and encode it.

    Labels of any type are mapped to 0, 1, ... in their order; ``classes`` keeps the map.
    A row without a label is an error. A supplied ``vocab`` brings its own marker ids;
    otherwise one is built from the training part. The given texts are read twice, for the
    digests and for writing the cleaned and split corpus.
    """
    spark = corpus.sparkSession
    named = corpus.select("doc_id", F.col("label").alias("class"), "text")
    write_table(labels.class_table(named, "class"), f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    corpus = labels.with_class(named, "class", classes).select("doc_id", "label", "text")
    cleaned, keys = clean.clean_with_keys(corpus, min_tokens)
    write_table(split.stratified_split(cleaned, keys=keys), f"{folder}/corpus", "split")
    rows = spark.read.parquet(f"{folder}/corpus")
    write_table(postings.postings(rows, ("label", "split"), max_len - 2), f"{folder}/words", "split")
    rows = spark.read.parquet(f"{folder}/words")
    if vocab is None:
        vocab, specials = encode.build_vocab(rows.where("split = 'train'")), encode.Specials()
    else:
        specials = encode.special_ids(vocab)
    write_table(vocab, f"{folder}/vocab")
    encoded = encode.encode(rows, vocab, max_len, specials, keep=("label", "split"))
    write_table(encoded, f"{folder}/encoded", partition_by="split")


def _scored(rows: DataFrame, scores: bayes.Scores) -> DataFrame:
    return evaluate.with_prediction(bayes.score(rows, scores), scores.classes)


def _linear(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows scored like those of the count model: log probabilities and the class."""
    scored = model.transform(rows.select("doc_id", "label", "text"))
    top = F.array_max("logits")
    mass = top + F.log(F.aggregate("logits", F.lit(0.0), lambda n, x: n + F.exp(x - top)))
    logits = F.transform("logits", lambda x: F.greatest(x - mass, F.lit(math.log(1e-300))))
    best = (F.array_position("logits", top) - 1).cast("int")
    return scored.select("doc_id", "label", logits.alias("logits"), best.alias("prediction"))


def scalars(batched: DataFrame, weights: DataFrame, classes: list, size: int) -> DataFrame:
    """One row: ``loss, accuracy``, and ``precision/<label>, recall/<label>, f1/<label>``."""
    one = loss.subset_scalars(batched, weights, classes).select("loss", "accuracy")
    per_label = evaluate.batch_mean_metrics(evaluate.batch_metrics(batched, classes, size))
    named = [
        F.max(F.when(F.col("label") == c, F.col(m))).alias(f"{m}/{c}") for m in ("precision", "recall", "f1") for c in classes
    ]
    # Both sides are aggregates of one row.
    return one.join(F.broadcast(per_label.agg(*named)))


def train(
    spark: SparkSession,
    folder: str,
    run_id: str,
    epoch: int = 0,
    batch_size: int = BATCH_SIZE,
    seed: int = TRAIN_SEED,
    num_epochs: int = 1,
    linear_model: bool = False,
) -> bayes.CountModel | PipelineModel:
    """Fit the prepared training part and save it as ``model/epoch-<epoch>``.

    From epoch 1 on, the counts go on top of the model of the epoch before: prepare new
    rows into the folder, then train the next epoch. With ``linear_model`` the logistic
    regression is fitted instead, to its end in epoch 0; a later epoch is an error. Loss, accuracy, precision,
    recall and F1 of both parts are recorded, the training batches in the epoch's shuffled
    order; training an epoch again replaces its records.
    """
    if linear_model and epoch:
        raise ValueError("the linear model is fitted to its end in epoch 0 and cannot be trained further")
    weights = saved(profile.class_weights(read_split(spark, f"{folder}/corpus", "train")), "weights")
    rows = _rows(spark, folder, "train", linear_model)
    path = _model_path(folder, epoch)
    if linear_model:
        linear.fit_linear(rows, weights).write().overwrite().save(path)
    else:
        prior = bayes.CountModel.read(spark, _model_path(folder, epoch - 1)) if epoch else None
        bayes.fit_counts(rows, prior).write(path)
    model, score, classes = _load(spark, path, linear_model)
    if not epoch:
        runs.record_params(
            spark,
            f"{folder}/run_params",
            run_id,
            {
                "num_epochs": num_epochs,
                "num_classes": weights.count(),
                "batch_size": batch_size,
                "seed": seed,
                "model_path": f"{folder}/model",
            },
        )
    valid = _rows(spark, folder, "valid", linear_model)
    for subset, batched in (
        ("train", rank.batches(score(rows), batch_size, seed, epoch)),
        ("valid", rank.batches(score(valid), batch_size)),
    ):
        values = saved(scalars(saved(batched, "scored"), weights, classes, batch_size), "scalars")
        runs.record_metrics(values, f"{folder}/run_metrics", run_id, epoch, subset)
    return model


def _load(spark: SparkSession, path: str, linear_model: bool):
    """A saved model, the function that scores rows with it, and its labels in order."""
    if linear_model:
        model = PipelineModel.load(path)
        return model, lambda rows: _linear(rows, model), list(range(model.stages[-1].numClasses))
    model = bayes.CountModel.read(spark, path)
    scores = bayes.scores_of(model)
    return model, lambda rows: _scored(rows, scores), scores.classes


def _rows(spark: SparkSession, folder: str, part: str, linear_model: bool) -> DataFrame:
    """What a model reads of a part: the linear one texts, the count model their words."""
    return read_split(spark, f"{folder}/corpus" if linear_model else f"{folder}/words", part)


def _model_path(folder: str, epoch: int) -> str:
    return f"{folder}/model/epoch-{epoch}"


def test(
    spark: SparkSession,
    folder: str,
    epoch: int = 0,
    batch_size: int = BATCH_SIZE,
    linear_model: bool = False,
) -> dict[str, DataFrame]:
    """``results`` per class, mean ``accuracy``, ``predictions`` and ``errors`` of the test part.

    Labels and predictions are class numbers; ``class`` and ``predicted_class`` (of
    ``results``: ``class``) give the caller's own values.
    """
    rows = read_split(spark, f"{folder}/corpus", "test").select("doc_id", "label", "text")
    names = spark.read.parquet(f"{folder}/classes")
    _, score, classes = _load(spark, _model_path(folder, epoch), linear_model)
    scored = score(_rows(spark, folder, "test", linear_model))
    batched = saved(rank.batches(scored, batch_size).drop("logits"), "predictions")
    predicted = names.select(F.col("label").alias("prediction"), F.col("class").alias("predicted_class"))

    def named(df):
        df = labels.with_class(df, "label", names)
        return labels.with_class(df, "prediction", predicted) if "prediction" in df.columns else df

    return {
        "results": named(evaluate.results_table(batched, classes, batch_size)).orderBy("label"),
        "accuracy": evaluate.mean_accuracy(evaluate.batch_accuracy(batched)),
        "predictions": named(batched),
        "errors": named(evaluate.errors(rows, batched)),
    }
