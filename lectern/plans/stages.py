"""The tables the steps hand to each other, each written once per application.

A classification task is a name and a way to read ``doc_id, label, text`` from the
given tables. Its later tables are built from the earlier ones, written under the
shared folder, and read from there by every query that needs them.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import (
    bayes, clean, encode, evaluate, labels, linear, postings, profile, rank, split,
)
from lectern.plans.shared import join_ids, scratch_path, spread
from lectern.plans.workflow import BATCH_SIZE, TRAIN_SEED
from lectern.sources.tables import write_table

SPLIT = "split"

_written: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text")


def stage(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write what ``build`` returns on first use and read it back from then on."""

    @wraps(build)
    def read(spark: SparkSession, sf_dir: str, task: str = "lang") -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, task, build.__name__)
        if key not in _written:
            df = build(spark, sf_dir, task)
            path = scratch_path(spark, build.__name__)
            write_table(df, path, SPLIT if SPLIT in df.columns else None)
            _written[key] = path
        return spark.read.parquet(_written[key])

    return read


@stage
def classes(spark, sf_dir, task):
    """Languages and their class numbers, found once."""
    return labels.class_table(table(spark, sf_dir, "documents"), "lang")


@stage
def flags(spark, sf_dir, task):
    """``doc_id, label`` of a flag task, without texts."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col(task).cast("int").alias("label"))


def corpus(spark: SparkSession, sf_dir: str, task: str = "lang") -> DataFrame:
    """``doc_id, label, text`` of a task: the language's number, or a flag of ``labels``."""
    docs = spread(table(spark, sf_dir, "documents"))
    if task == "lang":
        named = labels.with_class(docs, "lang", classes(spark, sf_dir))
        return named.select("doc_id", "label", "text")
    found = join_ids(docs.select("doc_id", "text"), flags(spark, sf_dir, task), "inner")
    return found.select("doc_id", "label", "text")


@stage
def cleaned(spark, sf_dir, task):
    return clean.clean(corpus(spark, sf_dir, task))


@stage
def split_corpus(spark, sf_dir, task):
    return split.stratified_split(cleaned(spark, sf_dir, task))


def part(spark, sf_dir, task="lang", name="train"):
    return split_corpus(spark, sf_dir, task).where(F.col(SPLIT) == name)


@stage
def split_words(spark, sf_dir, task):
    """The split corpus cut into words, once for all that count, encode or score them."""
    return postings.postings(split_corpus(spark, sf_dir, task), ("label", SPLIT), encode.MAX_LEN - 2)


def part_words(spark, sf_dir, task="lang", name="train"):
    return split_words(spark, sf_dir, task).where(F.col(SPLIT) == name)


@stage
def class_weights(spark, sf_dir, task):
    return profile.class_weights(part(spark, sf_dir, task))


@stage
def vocab(spark, sf_dir, task):
    return encode.build_vocab(part_words(spark, sf_dir, task))


@stage
def encoded(spark, sf_dir, task):
    return encode.encode(
        split_words(spark, sf_dir, task), vocab(spark, sf_dir, task), keep=("label", SPLIT)
    )


@stage
def model_tokens(spark, sf_dir, task):
    return bayes.fit_counts(part_words(spark, sf_dir, task)).tokens


@stage
def model_labels(spark, sf_dir, task):
    return bayes.fit_counts(part_words(spark, sf_dir, task)).labels


def model(spark, sf_dir, task="lang") -> bayes.CountModel:
    return bayes.CountModel(model_tokens(spark, sf_dir, task), model_labels(spark, sf_dir, task))


def class_list(spark, sf_dir, task="lang") -> list[int]:
    """The labels of the training part."""
    return labels.class_values(class_weights(spark, sf_dir, task), "label")


_scores: dict[tuple, bayes.Scores] = {}


def scores(spark, sf_dir, task="lang") -> bayes.Scores:
    key = (spark.sparkContext.applicationId, sf_dir, task)
    if key not in _scores:
        _scores[key] = bayes.scores_of(model(spark, sf_dir, task))
    return _scores[key]


@stage
def test_logits(spark, sf_dir, task):
    return bayes.score(part_words(spark, sf_dir, task, "test"), scores(spark, sf_dir, task))


@stage
def valid_logits(spark, sf_dir, task):
    return bayes.score(part_words(spark, sf_dir, task, "valid"), scores(spark, sf_dir, task))


@stage
def test_batches(spark, sf_dir, task):
    """Test rows in id order: ``doc_id, label, logits, prediction, position, batch_id``."""
    logits = test_logits(spark, sf_dir, task)
    predicted = evaluate.with_prediction(logits, scores(spark, sf_dir, task).classes)
    return rank.batches(predicted, BATCH_SIZE)


@stage
def train_batches(spark, sf_dir, task):
    """Training rows in the shuffled order of the first epoch."""
    logits = bayes.score(part_words(spark, sf_dir, task), scores(spark, sf_dir, task))
    predicted = evaluate.with_prediction(logits, scores(spark, sf_dir, task).classes)
    return rank.batches(predicted, BATCH_SIZE, TRAIN_SEED, epoch=0)


@stage
def valid_batches(spark, sf_dir, task):
    logits = valid_logits(spark, sf_dir, task)
    predicted = evaluate.with_prediction(logits, scores(spark, sf_dir, task).classes)
    return rank.batches(predicted, BATCH_SIZE)


_linear: dict[tuple, PipelineModel] = {}


def linear_model(spark, sf_dir, task="lang") -> PipelineModel:
    """The logistic regression of the training part, fitted on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, task)
    if key not in _linear:
        _linear[key] = linear.fit_linear(part(spark, sf_dir, task), class_weights(spark, sf_dir, task))
    return _linear[key]
