"""Class-weighted multinomial naive Bayes as plain aggregation.

The model is two additive count tables, so training further is a sum. Smoothing, the
vocabulary threshold and the class weights are applied when scoring.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators.labels import class_side, class_table
from lectern.operators.postings import is_postings, starts_row
from lectern.plans.shared import BROADCAST_BYTES, saved

LOGIT_DIGITS = 6
# Up to this many classes are summed in a column each, more of them in rows of their own.
COLUMN_CLASSES = 64


@dataclass(frozen=True)
class CountModel:
    """``tokens``: label, token, n. ``labels``: label, n_rows."""

    tokens: DataFrame
    labels: DataFrame

    def write(self, path: str) -> None:
        self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "CountModel":
        return CountModel(
            spark.read.schema("label INT, token STRING, n BIGINT").parquet(f"{path}/tokens"),
            spark.read.schema("label INT, n_rows BIGINT").parquet(f"{path}/labels"),
        )


def fit_counts(df: DataFrame, prior: CountModel | None = None) -> CountModel:
    """Count tokens and rows per label of the training rows' whole texts, on top of ``prior``.

    ``df`` holds texts or their postings. Frequent words are combined in the map tasks; a
    hot (label, token) reaches its reducer as one row per task.
    """
    if is_postings(df):
        tokens = df.where("word IS NOT NULL").groupBy("label", F.col("word").alias("token")).agg(F.sum("n").alias("n"))
        labels = df.where(starts_row()).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    else:
        tokens = (
            df.select("label", F.explode(words("text")).alias("token"))
            .groupBy("label", "token")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        labels = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    if prior is not None:
        tokens = tokens.unionByName(prior.tokens).groupBy("label", "token").agg(
            F.sum("n").alias("n")
        )
        labels = labels.unionByName(prior.labels).groupBy("label").agg(
            F.sum("n_rows").alias("n_rows")
        )
    return CountModel(tokens, labels)


def class_priors(model: CountModel) -> dict[int, float]:
    """ln of the weighted class shares, ``w_c n_c / sum(w n)`` with ``w_c = 1 - n_c / N``.

    One row per class reaches the driver.
    """
    counts = {r.label: r.n_rows for r in model.labels.collect()}
    total = sum(counts.values())
    mass = {c: (1 - n / total) * n for c, n in sorted(counts.items())}
    whole = sum(mass.values())
    if not whole:
        raise ValueError("training rows must hold at least 2 classes")
    return {c: math.log(m / whole) for c, m in mass.items()}


@dataclass(frozen=True)
class Scores:
    """A model ready to score.

    ``priors``: ln prior per class. ``unseen``: ln probability, per class in that order, of
    a listed token that the class has not seen. ``tokens``: saved ``token, n, cells``, whose
    ``place, s`` say by how much a class that has seen the token exceeds that; a cell of
    place -1 counts the token itself. A token takes the room of the classes it occurs in.
    """

    priors: dict[int, float]
    unseen: list[float]
    tokens: DataFrame

    @property
    def classes(self) -> list[int]:
        """The labels in the order of the scores."""
        return list(self.priors)


def scores_of(model: CountModel, min_count: int = 2, alpha: float = 1.0) -> Scores:
    """Smoothed log probabilities per listed token and class.

    Listed is every token seen ``min_count`` times. Every listed token has a score for
    every class. One row per class reaches the driver.
    """
    priors = class_priors(model)
    places = saved(class_table(model.labels, "label", "place"), "places")
    cell = F.struct("place", F.log((F.col("n") + alpha) / alpha).alias("s"), "n")
    counts = model.tokens.join(class_side(places), "label").groupBy("token").agg(
        F.sum("n").alias("n"), F.collect_list(cell).alias("cells")
    )
    listed = saved(counts.where(F.col("n") >= min_count), "token-counts")
    listed_tokens = listed.count()
    mass = {
        r.place: r.n
        for r in listed.select(F.inline("cells")).groupBy("place").agg(F.sum("n").alias("n")).collect()
    }
    unseen = [
        math.log(alpha / (mass.get(place, 0) + alpha * listed_tokens)) if listed_tokens else 0.0
        for place in range(len(priors))
    ]
    itself = F.array(F.struct(F.lit(-1).alias("place"), F.lit(1.0).alias("s")))
    cells = F.concat(itself, F.transform("cells", lambda c: F.struct(c.place.alias("place"), c.s.alias("s"))))
    return Scores(priors, unseen, listed.select("token", "n", cells.alias("cells")))


def _head_and_tail(scores: Scores, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent tokens that ``limit`` bytes hold, and the others if there are any."""
    width = F.octet_length("token") + 32 + 32 * F.size("cells")
    by_count = scores.tokens.groupBy("n").agg(F.sum(width).alias("size"))
    # Distinct counts sum to at most the number of words: a short table.
    falling = Window.orderBy(F.desc("n"))
    beyond = by_count.withColumn("upto", F.sum("size").over(falling)).where(F.col("upto") > limit)
    first_out = beyond.agg(F.max("n")).first()[0]
    tokens = scores.tokens
    if first_out is None:
        return tokens.drop("n"), None
    return tokens.where(F.col("n") > first_out).drop("n"), tokens.where(F.col("n") <= first_out).drop("n")


def _filled(cells: Column, n_classes: int) -> Column:
    """``cells`` of rising place as an array from place -1 on, zero where there is none."""
    cells = F.when(F.size(cells) > 0, cells).otherwise(
        F.array(F.struct(F.lit(-1).alias("place"), F.lit(0.0).alias("s")))
    )

    def with_gap(cell, i):
        following = F.coalesce(F.get(cells, i + 1)["place"], F.lit(n_classes))
        return F.concat(F.array(cell["s"]), F.array_repeat(F.lit(0.0), following - cell["place"] - 1))

    return F.flatten(F.transform(cells, with_gap))


def _column_sums(rows: DataFrame, scores: Scores, keys: list[str], head: DataFrame, tail: DataFrame | None) -> DataFrame:
    """``keys, sums``: a column for each class, summed in the pass that looks words up."""
    places = range(len(scores.priors))
    add = [F.sum(f"s{p}").alias(f"s{p}") for p in places]

    def wide(tokens: DataFrame) -> DataFrame:
        more = F.map_from_entries("cells")
        columns = [F.lit(u) + F.coalesce(F.try_element_at(more, F.lit(p)), F.lit(0.0)) for p, u in enumerate(scores.unseen)]
        return tokens.select("token", *[c.alias(f"s{p}") for p, c in enumerate(columns)])

    times = [(F.col("k") * F.col(f"s{p}")).alias(f"s{p}") for p in places]
    part = rows.join(F.broadcast(wide(head)), "token", "left").select(*keys, *times).groupBy(*keys).agg(*add)
    if tail is not None:
        rare = _left_over(rows, head).join(wide(tail), "token").select(*keys, *times)
        part = part.unionByName(rare).groupBy(*keys).agg(*add)
    return part.select(*keys, F.array(*[F.coalesce(F.col(f"s{p}"), F.lit(0.0)) for p in places]).alias("sums"))


def _row_sums(rows: DataFrame, scores: Scores, keys: list[str], head: DataFrame, tail: DataFrame | None) -> DataFrame:
    """``keys, sums``: a row for each class that a row's words occur in, put together last."""

    def sums(known: DataFrame) -> DataFrame:
        cells = known.select(*keys, "k", F.inline_outer("cells"))
        return cells.groupBy(*keys, "place").agg(F.sum(F.col("k") * F.col("s")).alias("s"))

    part = sums(rows.join(F.broadcast(head), "token", "left"))
    if tail is not None:
        part = part.unionByName(sums(_left_over(rows, head).join(tail, "token")))
        part = part.groupBy(*keys, "place").agg(F.sum("s").alias("s"))
    found = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "s"))))
    whole = part.groupBy(*keys).agg(found.alias("cells"))
    whole = whole.select(*keys, _filled(F.col("cells"), len(scores.priors)).alias("sums"))
    unseen, times = F.lit(scores.unseen), F.get("sums", F.lit(0))
    every = F.slice("sums", 2, len(scores.priors))
    return whole.select(*keys, F.transform(every, lambda x, i: times * F.get(unseen, i) + x).alias("sums"))


def _left_over(rows: DataFrame, head: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(head.select("token")), "token", "left_anti")


def score(
    df: DataFrame,
    scores: Scores,
    keep: tuple[str, ...] = ("label",),
    broadcast_bytes: int = BROADCAST_BYTES,
    column_classes: int = COLUMN_CLASSES,
) -> DataFrame:
    """``doc_id, *keep, logits`` with one score per class, for every row's whole text.

    ``df`` holds texts, which are cut once into a written table, or their postings. The
    scores of the most frequent tokens, as many as ``broadcast_bytes`` hold, are broadcast
    to the words. Rarer ones, which are no hot keys, are joined by a shuffle of the words
    that the first join leaves over. With more than ``column_classes`` classes, which
    changes no score, only the classes that a row's words occur in are summed. A row
    without a listed word keeps its priors.
    """
    keys = ["doc_id", *keep]
    if is_postings(df):
        rows = df.select(*keys, F.col("word").alias("token"), F.col("n").alias("k"))
    else:
        cut = df.select(*keys, F.explode_outer(words("text")).alias("token"))
        rows = saved(cut.groupBy(*keys, "token").agg(F.count("token").alias("k")), "cut-words")
    summed = _column_sums if len(scores.priors) <= column_classes else _row_sums
    sums = summed(rows, scores, keys, *_head_and_tail(scores, broadcast_bytes))
    priors = F.lit(list(scores.priors.values()))
    logits = F.transform("sums", lambda x, i: F.round(F.get(priors, i) + x, LOGIT_DIGITS))
    return sums.select(*keys, logits.alias("logits"))
