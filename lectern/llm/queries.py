"""The numbered queries: each applies its operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    alignment, byte_bpe, crf, decontaminate, forest, grammar, langid, pii, pseudo, repeats, superminhash, token_counts, zfast,
)
from lectern.plans.shared import saved, scratch_path
from lectern.plans.stages import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# The vocabulary of byte_bpe_50k.json as ranks.
PLAIN_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Appended to each document's ids.
END_ID = 2


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs), redact=False)
    counts = [F.col(f"pii.n_{kind}").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("pii.base", 256).alias("base_sha256"), F.col("pii.spans").alias("spans"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo.score(docs, pseudo.fit(docs)).select("doc_id", "lm.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(3, 1)
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~out))
    found = langid.identify(docs.drop("lang"), model)
    return found.select("doc_id", out.alias("held_out"), "language.lang_pred", "language.score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out(5, 0)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    scored = crf.quality(docs, crf.fit(docs, labels))
    score = F.col("quality")
    return scored.select("doc_id", out.alias("held_out"), score.alias("score"), crf.predicted(score, 0.3).alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, WORD_BPE).select("doc_id", "tokens.*")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.digests(coded)


def op11_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar.write_ids(docs, path, grammar.word_ids(WORD_BPE, END_ID))
    found = grammar.read_ids(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.report(docs, PLAIN_RANKS, public_tokenizers.PATTERN, PIECES)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = saved(zfast.turn_codes(table(spark, sf_dir, "conversations")), "turn-codes")
    conv_id = F.col("conv_id")
    kept = F.crc32(conv_id.cast("string").cast("binary")) % 6
    turns, sizes = zfast.rebuilt(codes, kept, conv_id - conv_id % 100)
    return zfast.build(turns, sizes).withColumnRenamed("saved", "saved_tokens")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_near_vectors, op2_near_copies, op3_pii, op4_repeats, op5_pseudo_likelihood, op6_decontaminate, op7_language, op8_quality, op9_token_counts, op10_byte_bpe, op11_grammar_ids, op12_alignment, op13_prefix_trie, pipeline]
    return {query.__name__: query for query in found}
