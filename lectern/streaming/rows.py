"""Cleaning steps that hold no state and so need neither watermark nor output mode."""

from pyspark.sql import DataFrame

from lectern.operators.clean import MIN_TOKENS, drop_empty, drop_short


def clean_rows(stream: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Strip, drop empty and short rows of a streaming or static corpus.

    Copies are left for the batch that follows: dropping them here would keep state
    for every text ever seen.
    """
    return drop_short(drop_empty(stream), min_tokens)
