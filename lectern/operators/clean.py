"""Strip, drop empty rows, drop later copies, drop short rows.

A corpus is ``doc_id BIGINT, label INT, text STRING`` with unique ``doc_id``; "first"
always means lowest ``doc_id``. A copy is a row equal in label *and* stripped text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import has_tokens, n_tokens, strip
from lectern.plans.shared import join_ids, saved, small_side

MIN_TOKENS = 6


def strip_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", strip("text"))


def empty_rows(df: DataFrame) -> DataFrame:
    return strip_text(df).where(F.col("text") == "")


def drop_empty(df: DataFrame) -> DataFrame:
    return strip_text(df).where(F.col("text") != "")


def with_n_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("n_tokens", n_tokens("text"))


def is_short(min_tokens: int = MIN_TOKENS) -> Column:
    """1 to ``min_tokens - 1`` tokens. Length 0 is the business of ``drop_empty``."""
    return F.col("n_tokens").between(1, min_tokens - 1)


def drop_short(df: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Tests for the ``min_tokens``-th token, so a dropped-or-kept decision is cheap and
    whole texts are counted once, for the rows that stay."""
    long_enough = has_tokens("text", min_tokens) | ~has_tokens("text", 1)
    return with_n_tokens(df.where(long_enough))


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Replace ``text`` by its 32-byte digest, so only narrow rows are shuffled."""
    return df.withColumn("fingerprint", F.unhex(F.sha2("text", 256))).drop("text")


def copy_groups(keys: DataFrame, *carry: str) -> DataFrame:
    """One row per distinct (label, text): first id and number of copies.

    The aggregate combines before its shuffle, so a text copied millions of times
    reaches the reducer as one row per map task. ``carry`` names further columns
    that depend on the text alone.
    """
    return keys.groupBy("label", "fingerprint", *carry).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")
    )


def _keys_and_later_copies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved ``doc_id, label, fingerprint`` of stripped rows, and saved ids of later copies.

    The text is read once, for the digests. Only groups with more than one row are
    looked at again; few of them are broadcast, and of more a hot one is a skewed join,
    which adaptive execution splits.
    """
    keys = saved(with_fingerprint(df.select("doc_id", "label", "text")), "fingerprints")
    groups = copy_groups(keys).where("n_copies > 1").withColumnRenamed("doc_id", "_first").drop("n_copies")
    copied = keys.join(small_side(saved(groups, "copy-groups")), ["label", "fingerprint"])
    return keys, saved(copied.where(F.col("doc_id") != F.col("_first")).select("doc_id"), "later-copies")


def later_copy_ids(df: DataFrame) -> DataFrame:
    """Saved table of the ids of 2nd and later copies. ``df`` must be stripped."""
    return _keys_and_later_copies(df)[1]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The 2nd and later copies of each row."""
    df = drop_empty(df)
    return join_ids(df, later_copy_ids(df), "left_semi")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first copy of each row."""
    df = drop_empty(df)
    return join_ids(df, later_copy_ids(df), "left_anti")


def clean_with_keys(
    df: DataFrame, min_tokens: int = MIN_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, and a saved ``doc_id, label`` of the same rows.

    The keys come from the digests, so whoever needs them reads no text.
    """
    df = drop_short(drop_empty(df), min_tokens)
    keys, later = _keys_and_later_copies(df)
    kept = saved(join_ids(keys.select("doc_id", "label"), later, "left_anti"), "clean-keys")
    return join_ids(df, later, "left_anti"), kept


def clean(df: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The whole cleaning: ``doc_id, label, text, n_tokens``.

    Copies have equal length, so dropping short rows first leaves the same rows and
    fewer digests to compare.
    """
    df = drop_short(drop_empty(df), min_tokens)
    return join_ids(df, later_copy_ids(df), "left_anti")
