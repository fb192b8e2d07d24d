"""One named query per operator, over the given tables."""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import (
    bayes, clean, encode, evaluate, join, labels, linear, loss, profile, rank, split,
)
from lectern.plans import stages, workflow
from lectern.plans.shared import join_ids, saved, scratch_path
from lectern.sources import delimited, runs, tables

Query = Callable[[SparkSession, str], DataFrame]

TASK_B = "quality"
TASK_C = "toxic"
EPOCHS = 3
# Bound of the gradient's length at the optimum, as a share of that without coefficients.
OPTIMUM = 1e-4
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(array: str):
    return F.array_join(F.col(array).cast("array<string>"), " ").alias(array)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- looking at the table -------------------------------------------------------


@query
def first_rows(spark, sf_dir):
    return profile.first_rows(stages.corpus(spark, sf_dir), 5)


@query
def point_lookup(spark, sf_dir):
    return profile.row_at(stages.corpus(spark, sf_dir), 42)


@query
def table_summary(spark, sf_dir):
    return profile.table_summary(stages.documents(spark, sf_dir))


@query
def label_index(spark, sf_dir):
    docs = stages.table(spark, sf_dir, "documents")
    return labels.with_class(docs.select("doc_id", "lang"), "lang", stages.classes(spark, sf_dir))


@query
def label_counts(spark, sf_dir):
    return profile.label_counts(stages.corpus(spark, sf_dir))


@query
def label_names(spark, sf_dir):
    return profile.label_names(stages.corpus(spark, sf_dir))


@query
def class_profile(spark, sf_dir):
    return _rounded(profile.class_profile(stages.corpus(spark, sf_dir)), "weight", digits=9)


# --- cleaning -------------------------------------------------------------------


@query
def strip_text(spark, sf_dir):
    return clean.strip_text(stages.corpus(spark, sf_dir)).select("doc_id", "text")


@query
def strip_turns(spark, sf_dir):
    turns = stages.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", text.strip("text").alias("text"),
    ).withColumn("n_tokens", text.n_tokens("text"))


@query
def empty_rows(spark, sf_dir):
    return clean.empty_rows(stages.corpus(spark, sf_dir))


@query
def drop_empty(spark, sf_dir):
    return clean.drop_empty(stages.corpus(spark, sf_dir))


def _segments(spark, sf_dir):
    """Sentence parts of the documents: many have outer blanks, some are empty."""
    parts = F.posexplode(F.split("text", r"\.")).alias("part", "text")
    return stages.documents(spark, sf_dir).select("doc_id", parts)


@query
def strip_segments(spark, sf_dir):
    return clean.strip_text(_segments(spark, sf_dir))


@query
def empty_segments(spark, sf_dir):
    return clean.empty_rows(_segments(spark, sf_dir))


@query
def drop_empty_segments(spark, sf_dir):
    return clean.drop_empty(_segments(spark, sf_dir))


@query
def duplicate_rows(spark, sf_dir):
    return clean.duplicate_rows(stages.corpus(spark, sf_dir)).select("doc_id", "label", "text")


@query
def dedup_keep_first(spark, sf_dir):
    return clean.drop_duplicates(stages.corpus(spark, sf_dir)).select("doc_id", "label", "text")


@query
def top_duplicates(spark, sf_dir):
    return profile.top_duplicates(stages.corpus(spark, sf_dir), 20).select(
        "doc_id", "label", "text"
    )


@query
def copy_groups(spark, sf_dir):
    groups = profile.distinct_texts(stages.corpus(spark, sf_dir))
    return groups.where("n_copies > 1").select("doc_id", "label", "n_copies")


@query
def drop_short(spark, sf_dir):
    return clean.drop_short(clean.drop_empty(stages.corpus(spark, sf_dir)))


@query
def drop_by_ids(spark, sf_dir):
    """Documents without a label row, by an id list that is itself a table."""
    ids = stages.table(spark, sf_dir, "labels").select("doc_id")
    return join_ids(stages.corpus(spark, sf_dir), ids, "left_anti").select("doc_id", "label")


@query
def cleaned_corpus(spark, sf_dir):
    return clean.clean(stages.corpus(spark, sf_dir)).select("doc_id", "label", "n_tokens", "text")


# --- lengths --------------------------------------------------------------------


@query
def token_counts(spark, sf_dir):
    rows = clean.with_n_tokens(clean.drop_empty(stages.corpus(spark, sf_dir)))
    return rows.select("doc_id", "n_tokens")


@query
def length_histogram(spark, sf_dir):
    return profile.length_histogram(stages.corpus(spark, sf_dir))


@query
def longest_doc(spark, sf_dir):
    return profile.longest_row(stages.corpus(spark, sf_dir))


@query
def shortest_doc(spark, sf_dir):
    return profile.shortest_row(stages.corpus(spark, sf_dir))


@query
def rows_by_length(spark, sf_dir):
    return profile.rows_by_length(stages.corpus(spark, sf_dir), 0, 7)


@query
def first_rows_by_length(spark, sf_dir):
    return profile.rows_by_length(stages.corpus(spark, sf_dir), 0, 7, first=2)


@query
def count_by_length(spark, sf_dir):
    return profile.count_by_length(stages.corpus(spark, sf_dir), 0, 7)


# --- numbering, batches, splits -------------------------------------------------


@query
def row_numbers(spark, sf_dir):
    """Dense position of the rows that de-duplication keeps."""
    groups = profile.distinct_texts(stages.corpus(spark, sf_dir))
    return rank.row_numbers(groups.select("doc_id", "label"), "doc_id")


@query
def batch_numbers(spark, sf_dir):
    rows = stages.part(spark, sf_dir, name="test").select("doc_id", "label")
    return rank.batches(rows, stages.BATCH_SIZE)


@query
def batch_totals(spark, sf_dir):
    return rank.batch_totals(stages.split_corpus(spark, sf_dir), stages.BATCH_SIZE, EPOCHS)


@query
def epoch_shuffle(spark, sf_dir):
    rows = stages.part(spark, sf_dir, name="train").select("doc_id", "label")
    return rank.batches(rows, stages.BATCH_SIZE, seed=stages.TRAIN_SEED, epoch=1)


@query
def stratified_split(spark, sf_dir):
    return split.stratified_split(
        stages.cleaned(spark, sf_dir).select("doc_id", "label", "text")
    )


@query
def split_sizes(spark, sf_dir):
    return stages.split_corpus(spark, sf_dir).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def approx_split(spark, sf_dir):
    return split.approximate_split(stages.corpus(spark, sf_dir).select("doc_id", "label"))


@query
def class_weights(spark, sf_dir):
    return _rounded(profile.class_weights(stages.part(spark, sf_dir)), "weight", digits=9)


@query
def row_weights(spark, sf_dir):
    weights = stages.class_weights(spark, sf_dir).select("label", "weight")
    rows = stages.part(spark, sf_dir).select("doc_id", "label")
    return _rounded(rows.join(labels.class_side(weights), "label"), "weight", digits=9)


# --- vocabulary and encoding ----------------------------------------------------


@query
def words(spark, sf_dir):
    """Normalised words of every document, in order."""
    docs = stages.corpus(spark, sf_dir)
    return docs.select("doc_id", text.words("text").alias("words")).select(
        "doc_id", F.size("words").alias("n_words"), _joined("words")
    )


@query
def vocabulary(spark, sf_dir):
    return encode.build_vocab(stages.part_words(spark, sf_dir))


def _word_pieces(spark, sf_dir, **how):
    """Pieces of every distinct word of the cleaned corpus."""
    every = stages.split_words(spark, sf_dir).select("word").where("word IS NOT NULL")
    one_each = every.distinct().withColumn("words", F.array("word"))
    vocab, unk = stages.vocab(spark, sf_dir), encode.Specials().unk
    return encode.with_pieces(one_each, "word", vocab, unk, **how).select("word", _joined("ids"))


@query
def word_pieces(spark, sf_dir):
    return _word_pieces(spark, sf_dir)


@query
def word_pieces_by_join(spark, sf_dir):
    """The same with neither vocabulary nor lexicon broadcast."""
    return _word_pieces(spark, sf_dir, broadcast_bytes=0)


def _encoded(spark, sf_dir, **how):
    encoded = encode.encode(
        stages.split_words(spark, sf_dir), stages.vocab(spark, sf_dir), keep=("label", "split"), **how
    )
    return encoded.select(
        "doc_id", "label", "split", "n_words", _joined("token_ids"), _joined("attention_mask")
    )


@query
def encode_fixed(spark, sf_dir):
    return _encoded(spark, sf_dir)


@query
def encode_large_vocab(spark, sf_dir):
    """The same as if the vocabulary were too large to be broadcast."""
    return _encoded(spark, sf_dir, broadcast_bytes=0)


@query
def truncation_report(spark, sf_dir):
    report = encode.truncation_report(stages.encoded(spark, sf_dir))
    return _rounded(report, "share_truncated", digits=9)


@query
def encoded_join(spark, sf_dir):
    rows = stages.split_corpus(spark, sf_dir).select("doc_id", "label", "text")
    arrays = stages.encoded(spark, sf_dir).select("doc_id", "token_ids", "attention_mask")
    return join.join_encoded(rows, arrays).select(
        "doc_id",
        "label",
        F.md5("text").alias("text_md5"),
        _joined("token_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_real"),
    )


@query
def unmatched_ids(spark, sf_dir):
    """Ids found in only one of documents and labels."""
    return join.unmatched(
        stages.table(spark, sf_dir, "documents"), stages.table(spark, sf_dir, "labels")
    )


# --- model ----------------------------------------------------------------------


def _logit_columns(logits: DataFrame, n: int) -> DataFrame:
    return logits.select(
        "doc_id", "label", *[F.element_at("logits", c + 1).alias(f"z{c}") for c in range(n)]
    )


@query
def nb_model(spark, sf_dir):
    return bayes.fit_counts(stages.part_words(spark, sf_dir)).tokens


@query
def nb_labels(spark, sf_dir):
    return bayes.fit_counts(stages.part_words(spark, sf_dir)).labels


@query
def nb_resume(spark, sf_dir):
    """Fit on half of the training rows, save, load, and go on with the other half."""
    train = stages.part_words(spark, sf_dir)
    path = scratch_path(spark, "half-model")
    bayes.fit_counts(train.where("doc_id % 2 = 0")).write(path)
    half = bayes.CountModel.read(spark, path)
    return bayes.fit_counts(train.where("doc_id % 2 = 1"), prior=half).tokens


@query
def nb_logits(spark, sf_dir):
    test = stages.part_words(spark, sf_dir, name="test")
    return _logit_columns(bayes.score(test, bayes.scores_of(stages.model(spark, sf_dir))), 4)


@query
def nb_logits_split(spark, sf_dir):
    """The same as if few of the token scores could be broadcast."""
    test = stages.part_words(spark, sf_dir, name="test")
    scores = bayes.scores_of(stages.model(spark, sf_dir))
    return _logit_columns(bayes.score(test, scores, broadcast_bytes=20_000), 4)


@query
def quality_logits(spark, sf_dir):
    test = stages.part_words(spark, sf_dir, TASK_B, "test")
    return _logit_columns(bayes.score(test, bayes.scores_of(stages.model(spark, sf_dir, TASK_B))), 2)


@query
def predictions(spark, sf_dir):
    return _predicted(spark, sf_dir)


def _predicted(spark, sf_dir, task="lang"):
    return evaluate.predict(stages.test_logits(spark, sf_dir, task), stages.class_list(spark, sf_dir, task))


@query
def quality_predictions(spark, sf_dir):
    return _predicted(spark, sf_dir, TASK_B)


@query
def shifted_labels(spark, sf_dir):
    """The quality task with labels 5 and 6: predictions are labels, not positions."""
    shift = F.col("label") + 5
    train = stages.part_words(spark, sf_dir, TASK_B).withColumn("label", shift)
    test = stages.part_words(spark, sf_dir, TASK_B, "test").withColumn("label", shift)
    scores = bayes.scores_of(bayes.fit_counts(train))
    rows = loss.with_nll(evaluate.with_prediction(bayes.score(test, scores), scores.classes), scores.classes)
    return _rounded(rows.select("doc_id", "label", "prediction", "nll"), "nll")


def _batch_losses(spark, sf_dir, name="test", task="lang"):
    batched = getattr(stages, f"{name}_batches")(spark, sf_dir, task)
    return loss.weighted_loss(batched, stages.class_weights(spark, sf_dir, task), stages.class_list(spark, sf_dir, task))


@query
def row_loss(spark, sf_dir):
    rows = loss.with_nll(stages.test_logits(spark, sf_dir))
    return _rounded(rows.select("doc_id", "label", "nll"), "nll")


@query
def weighted_loss_by_batch(spark, sf_dir):
    return _rounded(_batch_losses(spark, sf_dir), "loss")


@query
def train_loss_by_batch(spark, sf_dir):
    """Training batches in the shuffled order of an epoch."""
    return _rounded(_batch_losses(spark, sf_dir, "train"), "loss")


@query
def epoch_loss(spark, sf_dir):
    return _rounded(loss.epoch_loss(_batch_losses(spark, sf_dir)), "loss")


@query
def progress_loss(spark, sf_dir):
    """Every second batch, so that the smallest tables show some."""
    return _rounded(loss.progress(_batch_losses(spark, sf_dir), 2), "loss")


# --- evaluation -----------------------------------------------------------------


@query
def batch_accuracy(spark, sf_dir):
    batched = stages.test_batches(spark, sf_dir, TASK_B)
    return _rounded(evaluate.batch_accuracy(batched), "accuracy", digits=9)


@query
def batch_metrics(spark, sf_dir):
    return evaluate.batch_metrics(
        stages.test_batches(spark, sf_dir), stages.class_list(spark, sf_dir), stages.BATCH_SIZE
    )


@query
def batch_mean_metrics(spark, sf_dir):
    per_batch = evaluate.batch_metrics(
        stages.test_batches(spark, sf_dir, TASK_B),
        stages.class_list(spark, sf_dir, TASK_B),
        stages.BATCH_SIZE,
    )
    return _rounded(evaluate.batch_mean_metrics(per_batch), "precision", "recall", "f1")


@query
def results_table(spark, sf_dir):
    table = evaluate.results_table(
        stages.test_batches(spark, sf_dir), stages.class_list(spark, sf_dir), stages.BATCH_SIZE
    )
    return _rounded(table, "precision", "recall", "f1")


@query
def mean_accuracy(spark, sf_dir):
    per_batch = evaluate.batch_accuracy(stages.test_batches(spark, sf_dir))
    return _rounded(evaluate.mean_accuracy(per_batch), "accuracy")


@query
def global_metrics(spark, sf_dir):
    predicted = _predicted(spark, sf_dir, TASK_B)
    metrics = evaluate.global_metrics(predicted, stages.class_list(spark, sf_dir, TASK_B))
    return _rounded(metrics, "precision", "recall", "f1")


@query
def predicted_texts(spark, sf_dir):
    """Every test row with its prediction."""
    predicted = _predicted(spark, sf_dir)
    return evaluate.with_predictions(stages.part(spark, sf_dir, name="test"), predicted)


@query
def error_rows(spark, sf_dir):
    predicted = _predicted(spark, sf_dir, TASK_C)
    test = stages.part(spark, sf_dir, TASK_C, "test")
    return evaluate.errors(test, predicted)


@query
def first_error_rows(spark, sf_dir):
    predicted = _predicted(spark, sf_dir, TASK_C)
    test = stages.part(spark, sf_dir, TASK_C, "test")
    return evaluate.errors(test, predicted, first=5)


@query
def valid_report(spark, sf_dir):
    """Loss and accuracy of the validation part."""
    report = loss.subset_scalars(
        stages.valid_batches(spark, sf_dir), stages.class_weights(spark, sf_dir), stages.class_list(spark, sf_dir)
    )
    return _rounded(report, "loss", "accuracy")


# --- files and run records ------------------------------------------------------


def _text_round_trip(spark, sf_dir, sep):
    path = scratch_path(spark, "corpus-text")
    tables.write_text_corpus(stages.corpus(spark, sf_dir), path, sep=sep)
    rows = delimited.read_quoted(spark, path, tables.CORPUS_SCHEMA, sep, name="position")
    return rows.select("position", "label", F.md5("text").alias("text_md5"))


@query
def text_round_trip(spark, sf_dir):
    """Write the corpus as tab-separated text, read it back, number the rows."""
    return _text_round_trip(spark, sf_dir, "\t")


@query
def text_round_trip_spaces(spark, sf_dir):
    """The same with blanks between the fields."""
    return _text_round_trip(spark, sf_dir, " ")


@query
def split_round_trip(spark, sf_dir):
    """Write the three parts as one partitioned table and read each of them back."""
    path = scratch_path(spark, "split-table")
    tables.write_table(stages.split_corpus(spark, sf_dir), path, partition_by="split")
    parts = [tables.read_split(spark, path, name) for name in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "label", "split")


@query
def empty_array_round_trip(spark, sf_dir):
    """Ids of the long words of each document as JSON arrays, many of them empty."""
    docs = stages.documents(spark, sf_dir)
    sizes = F.transform(text.words("text"), lambda w: F.length(w))
    path = scratch_path(spark, "sizes")
    tables.write_json_arrays(docs.select("doc_id", F.filter(sizes, lambda n: n > 18).alias("sizes")), "sizes", path)
    return tables.read_json_arrays(spark, path, "sizes").select("position", _joined("sizes"))


@query
def array_round_trip(spark, sf_dir):
    """Write token ids and masks as JSON arrays, read them back, and join by place."""
    encoded = stages.encoded(spark, sf_dir)
    read = []
    for column in ("token_ids", "attention_mask"):
        path = scratch_path(spark, column)
        tables.write_json_arrays(encoded, column, path)
        read.append(tables.read_json_arrays(spark, path, column))
    ids, masks = read
    return ids.join(masks, "position").select(
        "position", _joined("token_ids"), _joined("attention_mask")
    )


@query
def model_round_trip(spark, sf_dir):
    """Save a model, load it, and score the validation part."""
    path = scratch_path(spark, "model")
    stages.model(spark, sf_dir).write(path)
    loaded = bayes.scores_of(bayes.CountModel.read(spark, path))
    return _logit_columns(bayes.score(stages.part_words(spark, sf_dir, name="valid"), loaded), 4)


@query
def run_metrics(spark, sf_dir):
    """The epoch's values of both subsets, recorded twice, as by a rerun, and read."""
    path = scratch_path(spark, "run-metrics")
    weights, classes = stages.class_weights(spark, sf_dir), stages.class_list(spark, sf_dir)
    for subset in ("train", "valid", "valid"):
        batched = getattr(stages, f"{subset}_batches")(spark, sf_dir)
        values = workflow.scalars(batched, weights, classes, stages.BATCH_SIZE)
        runs.record_metrics(values, path, "run", 0, subset)
    return _rounded(runs.read_metrics(spark, path), "value")


@query
def run_params(spark, sf_dir):
    path = scratch_path(spark, "run-params")
    n_classes = len(stages.class_list(spark, sf_dir))
    # The parameter names of the published run.
    params = {"num_epochs": EPOCHS, "num_classes": n_classes, "batch_size": stages.BATCH_SIZE}
    runs.record_params(spark, path, "run", params)
    return runs.read_params(spark, path)


# --- linear model ---------------------------------------------------------------


@query
def lr_predictions(spark, sf_dir):
    """Every test row, and whether its prediction is a class of the training part.

    The weights of an iterative solver have no SQL form; see ``lr_optimum``.
    """
    found = linear.predict_linear(stages.part(spark, sf_dir, name="test"), stages.linear_model(spark, sf_dir))
    known = F.col("prediction").isin(stages.class_list(spark, sf_dir))
    return found.select("doc_id", "label", known.alias("known"))


@query
def lr_reloaded(spark, sf_dir):
    """The same by the model as saved and loaded again, next to the fitted one's answer."""
    path = scratch_path(spark, "linear")
    fitted = stages.linear_model(spark, sf_dir)
    fitted.write().overwrite().save(path)
    test = stages.part(spark, sf_dir, name="test")
    again = linear.predict_linear(test, PipelineModel.load(path))
    both = again.join(linear.predict_linear(test, fitted).withColumnRenamed("prediction", "fitted"), ["doc_id", "label"])
    return both.select("doc_id", "label", (F.col("prediction") == F.col("fitted")).alias("same"))


@query
def lr_optimum(spark, sf_dir):
    """Each class of the training part, and whether the loss has no slope left in its
    coefficients: found from the data by joins, not from the solver's report."""
    betas = saved(linear.coefficients(spark, stages.linear_model(spark, sf_dir)), "betas")
    norms = linear.gradient_norms(stages.part_words(spark, sf_dir), stages.class_weights(spark, sf_dir), betas)
    return norms.select("label", "n_rows", (F.col("norm") <= OPTIMUM * F.col("start")).alias("at_optimum"))
