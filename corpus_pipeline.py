"""A training corpus from raw documents: language, near copies, leaks, personal data, tokens.

Each stage takes the documents that the one before kept, calls one operator of
``lectern.llm``, and acts on what it decides.
"""

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, decontaminate, langid, pii, superminhash
from lectern.llm.queries import BYTE_RANKS
from lectern.plans.shared import join_ids, saved, scratch_path
from lectern.plans.stages import table

# Least posterior of the language found; below it a document counts as unidentified.
LEAST_SCORE = 0.5
# Bytes of rows that a task hands to Python at once; a longer row goes alone.
BATCH_BYTES = 2 << 20


def in_short_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with Arrow batches of about ``BATCH_BYTES`` instead of 10,000 rows each.

    Rows are whole documents, and a batch is held by the executor and by its Python worker,
    several times on the way. The session keeps the setting, as rows are made after the stage
    has returned; no result depends on it.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


@in_short_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified; unknown and doubtful ones go."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(3, 1))
    name = free_name(docs, "language")
    found = langid.identify(docs, langid.fit(learn), name)
    known = (F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


@in_short_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that of the least id.

    A row without an id is a document of its own and gives way to any row with one. Rows
    repeated under an id with one text are one group, also without words; texts without
    words are no copies otherwise. Rows of one id with different texts are compared as well.
    """
    rows, ids, different = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if not rows == ids == different:
        return _one_row_of_each(docs)
    found = superminhash.near_copies(docs.select("doc_id", "text"))
    copies = found.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return join_ids(docs, saved(copies, "copies"), "left_anti").select(*docs.columns)


def _one_row_of_each(docs: DataFrame) -> DataFrame:
    """``drop_near_copies`` where ids are missing or repeated, by a written row number."""
    row = free_name(docs, "row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = superminhash.near_copies(rows.select(F.col(row).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    marked = rows.select(row, "doc_id", F.xxhash64("text").alias("digest")).join(saved(found, "row-copies"), row)
    blank = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [
        F.when(~blank, F.col("component_id")).alias("component"),
        F.when(blank, F.col("doc_id")).alias("id"),
        F.when(blank, F.col("digest")).alias("blank"),
    ]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))).alias("least")
    stay = saved(marked.groupBy(*group).agg(least).select(F.col("least.row").alias(row)), "kept-rows")
    return join_ids(rows, stay, "left_semi", row).select(*docs.columns)


@in_short_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark passage."""
    name = free_name(docs, "leak")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), name)
    return found.where(F.size(f"{name}.hits") == 0).select(*docs.columns)


@in_short_batches
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text where there is one."""
    name = free_name(docs, "pii")
    found = pii.detect(docs, pii.fit(docs), name)
    changed = found.withColumn("text", F.col(f"{name}.redacted"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        changed = changed.withColumn("n_chars", F.when(F.col(f"{name}.spans") != "", length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


@in_short_batches
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its bytes back."""
    name = free_name(docs, "bpe")
    coded = byte_bpe.encode_checked(docs, BYTE_RANKS, public_tokenizers.PATTERN, name)
    new = {
        free_name(docs, "token_ids"): F.col(f"{name}.ids"),
        free_name(docs, "n_tokens"): F.size(f"{name}.ids").cast("long"),
        free_name(docs, "round_trip"): F.col(f"{name}.same"),
    }
    return coded.withColumns(new).select(*docs.columns, *new)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

# Languages, personal data and tokens have no SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
