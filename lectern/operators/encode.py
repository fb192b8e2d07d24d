"""Vocabulary, word pieces and fixed-length encoding."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import frame_ids, mask, pad_right
from lectern.functions.text import words
from lectern.operators.postings import is_postings, places_of, reached_words
from lectern.operators.rank import row_numbers
from lectern.plans.shared import BROADCAST_BYTES, most_frequent, saved, small_side

MAX_LEN = 128
# Longer words are unknown to the published tokenizer, and its prefix
# of pieces that continue a word.
MAX_WORD_CHARS = 100
CONTINUATION = "##"
# Characters by which the lengths of tokens are looked up.
LEAD = 3


@dataclass(frozen=True)
class Specials:
    """Ids of the marker tokens. The defaults are those of ``build_vocab``."""

    pad: int = 0
    unk: int = 1
    cls: int = 2
    sep: int = 3


# Marker tokens in the order of their default ids.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def word_counts(df: DataFrame) -> DataFrame:
    """``token, n`` of every word of whole texts, or of their postings."""
    if is_postings(df):
        return df.where("word IS NOT NULL").groupBy(F.col("word").alias("token")).agg(F.sum("n").alias("n"))
    return (
        df.select(F.explode(words("text")).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def build_vocab(
    df: DataFrame, min_count: int = 2, max_words: int | None = None, max_alphabet: int | None = None
) -> DataFrame:
    """Saved table ``token, id`` of the markers, the words and the alphabet of ``df``.

    Words of two or more characters that occur ``min_count`` times, and every single
    character both as word start and as continuation, so that unlisted words can still be
    spelled. Only a caller's ``max_words`` or ``max_alphabet`` keeps the most frequent
    alone. Ids follow the markers by falling count, then token. Give it the training rows
    or their postings.
    """
    counts = saved(word_counts(df), "word-counts")
    listed = counts.where((F.col("n") >= min_count) & (F.length("token") > 1))
    if max_words is not None:
        listed = most_frequent(listed, max_words, "frequent-words")
    at = F.explode(F.sequence(F.lit(1), F.length("token")))
    letter = F.when(F.col("at") == 1, F.expr("substring(token, 1, 1)")).otherwise(
        F.concat(F.lit(CONTINUATION), F.expr("substring(token, at, 1)"))
    )
    letters = counts.select("token", "n", at.alias("at")).select("n", letter.alias("token"))
    alphabet = letters.groupBy("token").agg(F.sum("n").alias("n"))
    if max_alphabet is not None:
        alphabet = alphabet.orderBy(F.desc("n"), "token").limit(max_alphabet)
    # A word that looks like a continued letter is listed once, with the greater count.
    tokens = listed.select("token", "n").unionByName(alphabet).groupBy("token").agg(F.max("n").alias("n"))
    numbered = row_numbers(tokens, F.desc("n"), "token", name="id").select(
        "token", (F.col("id") + len(SPECIAL_TOKENS)).cast("int").alias("id")
    )
    markers = df.sparkSession.createDataFrame(
        list(zip(SPECIAL_TOKENS, range(len(SPECIAL_TOKENS)))), "token STRING, id INT"
    )
    return saved(markers.unionByName(numbered), "vocab")


def special_ids(vocab: DataFrame) -> Specials:
    """Marker ids of a supplied vocabulary. At most four rows reach the driver."""
    found = {r.token: r.id for r in vocab.where(F.col("token").isin(*SPECIAL_TOKENS)).collect()}
    missing = [t for t in SPECIAL_TOKENS if t not in found]
    if missing:
        raise ValueError(f"vocabulary lacks {missing}")
    return Specials(*[found[t] for t in SPECIAL_TOKENS])


def token_lengths(vocab: DataFrame) -> DataFrame:
    """``continues, lead, sizes``: which lengths the tokens have that begin with a lead.

    A lead is a token's first three characters, or all of a shorter one. Tokens that continue
    a word are listed by what follows their prefix, and every token as a word start.
    """
    starts = vocab.select(F.lit(False).alias("continues"), F.col("token").alias("body"))
    inner = vocab.where(F.col("token").startswith(CONTINUATION)).select(
        F.lit(True).alias("continues"), F.expr(f"substring(token, {len(CONTINUATION) + 1})").alias("body")
    )
    return (
        starts.unionByName(inner)
        .where("body <> ''")
        .groupBy("continues", F.substring("body", 1, LEAD).alias("lead"))
        .agg(F.sort_array(F.collect_set(F.length("body"))).alias("sizes"))
    )


def _spans(df: DataFrame, vocab: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The vocabulary's matches in each ``word``: ``at, size, id`` and the length ``n``.

    A listed word matches as a whole. In any other, every place is looked up by its first
    characters, which tells the few lengths that a token there can have; only these are
    looked up in the vocabulary. The full word always stays as a row, without an id if
    unlisted.
    """
    lengths = saved(token_lengths(vocab), "token-lengths")
    # Two rows: the longest lead of word starts and of continuations.
    leads = {r.continues: r.n for r in lengths.groupBy("continues").agg(F.max(F.length("lead")).alias("n")).collect()}
    lengths, vocab = small_side(lengths, broadcast_bytes), small_side(vocab, broadcast_bytes)
    whole_words = vocab.select(F.col("token").alias("word"), F.col("id").alias("whole"))
    pieces = vocab.select(F.col("token").alias("piece"), "id")
    marked = df.join(whole_words, "word", "left").withColumn("n", F.length("word"))
    full = marked.select("word", "n", F.lit(0).alias("at"), F.col("n").alias("size"), F.col("whole").alias("id"))
    last = F.col("n") - 1 if True in leads else F.lit(0)
    continues = F.col("at") > 0
    most = F.when(continues, leads.get(True, 0)).otherwise(leads.get(False, 0))
    places = (
        marked.where(F.col("whole").isNull() & F.col("n").between(1, MAX_WORD_CHARS))
        .select("word", "n", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .where(most > 0)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(most, F.col("n") - F.col("at")))))
        .select("word", "n", "at", continues.alias("continues"), F.expr("substring(word, at + 1, k)").alias("lead"))
    )
    piece = F.when(F.col("at") == 0, F.expr("substring(word, 1, size)")).otherwise(
        F.concat(F.lit(CONTINUATION), F.expr("substring(word, at + 1, size)"))
    )
    found = (
        places.join(lengths, ["continues", "lead"])
        .select("word", "n", "at", F.explode("sizes").alias("size"))
        .where(F.col("size") <= F.col("n") - F.col("at"))
        .withColumn("piece", piece)
        .join(pieces, "piece")
    )
    return full.unionByName(found.select("word", "n", "at", "size", "id"))


def _walk(spans: str, unk: int) -> Column:
    """Fold sorted spans ``(at_word, at, -size, id, n)`` into the pieces of all words.

    Within a word only a match that starts where the last one ended is taken; the sort
    puts the longest first. A word not walked to its end gives one unknown piece.
    """
    no_ids = F.array().cast("array<int>")
    nowhere = F.struct(
        F.lit(-1).alias("word"),
        F.lit(0).alias("at"),
        F.lit(0).alias("n"),
        no_ids.alias("ids"),
        no_ids.alias("done"),
    )

    def closed(walk):
        ids = F.when(walk["at"] == walk["n"], walk["ids"]).otherwise(F.array(F.lit(unk)))
        return F.concat(walk["done"], ids)

    def take(span, at, ids, done):
        fits = (span["at"] == at) & span["id"].isNotNull()
        return F.struct(
            span["at_word"].alias("word"),
            F.when(fits, span["at"] - span["rank"]).otherwise(at).alias("at"),
            span["n"].alias("n"),
            F.when(fits, F.concat(ids, F.array(span["id"]))).otherwise(ids).alias("ids"),
            done.alias("done"),
        )

    def step(walk, span):
        return F.when(
            span["at_word"] == walk["word"], take(span, walk["at"], walk["ids"], walk["done"])
        ).otherwise(take(span, F.lit(0), no_ids, closed(walk)))

    return F.aggregate(spans, nowhere, step, closed)


def spell(lexicon: DataFrame, vocab: DataFrame, unk: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``word, ids``: the pieces of each of the distinct, non-null words.

    Greedy longest match from the left. A word meets its own matches alone in one row.
    """
    span = F.struct(F.lit(0).alias("at_word"), "at", (-F.col("size")).alias("rank"), "id", "n")
    return (
        _spans(lexicon.select("word"), vocab, broadcast_bytes)
        .groupBy("word")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"))
        .select("word", _walk("spans", unk).alias("ids"))
    )


def with_pieces(
    df: DataFrame,
    key: str,
    vocab: DataFrame,
    unk: int,
    carry: tuple[str, ...] = (),
    limit: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``key, *carry, ids``: the pieces of each row's ``words``, at most ``limit`` of them.

    ``key`` must be unique, ``carry`` columns depend on it; see ``pieces_of_rows``.
    """
    # The key may be called as the words are.
    rows = df.select(F.col(key).alias("_key"), *carry, F.posexplode_outer("words").alias("at_word", "word"))
    return pieces_of_rows(rows, "_key", vocab, unk, carry, limit, broadcast_bytes).withColumnRenamed("_key", key)


def pieces_of_rows(
    rows: DataFrame,
    key: str,
    vocab: DataFrame,
    unk: int,
    carry: tuple[str, ...] = (),
    limit: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``key, *carry, ids`` from ``key, *carry, at_word, word``, in order of the places.

    ``at_word`` is a place, or the bits of all places of the word in its row, which then meets
    its pieces once and is set out when the row is put together.
    Each distinct word is spelled once, whatever the size of the vocabulary; a vocabulary
    or lexicon of at most ``broadcast_bytes`` is broadcast, a larger one is joined by word,
    where adaptive execution splits frequent words. A token listed twice counts with its
    lower id. A null word has no pieces; its row keeps the key.
    """
    once = vocab.groupBy("token").agg(F.min("id").alias("id"))
    rows = rows.select(F.col(key).alias("_key"), *carry, "at_word", "word")
    lexicon = saved(rows.select("word").where(F.col("word").isNotNull()).distinct(), "lexicon")
    pieces = saved(spell(lexicon, saved(once, "vocab-once"), unk, broadcast_bytes), "pieces")
    found = rows.join(small_side(pieces, broadcast_bytes), "word", "left")
    placed = F.when(F.col("word").isNotNull(), F.struct("at_word", "ids"))
    listed = F.collect_list(placed)
    if dict(rows.dtypes)["at_word"].startswith("array"):
        listed = F.flatten(
            F.transform(
                listed,
                lambda x: F.transform(places_of(x["at_word"]), lambda at: F.struct(at.alias("at_word"), x["ids"].alias("ids"))),
            )
        )
    ids = F.flatten(F.transform(F.sort_array(listed), lambda x: x["ids"]))
    if limit is not None:
        ids = F.slice(ids, 1, limit)
    return (
        found.groupBy("_key")
        .agg(*[F.first(c).alias(c) for c in carry], ids.alias("ids"))
        .select(F.col("_key").alias(key), *carry, "ids")
    )


def encode(
    df: DataFrame,
    vocab: DataFrame,
    max_len: int = MAX_LEN,
    specials: Specials = Specials(),
    keep: tuple[str, ...] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, *keep, n_words, truncated, token_ids, attention_mask`` for every row.

    ``df`` holds texts or their postings. A word yields at least one piece, so words after
    the first ``max_len - 2`` cannot reach the encoding and are not looked up.
    """
    limit = max_len - 2
    carry = (*keep, "n_words")
    if is_postings(df):
        rows = reached_words(df, carry, limit)
    else:
        cut = df.select("doc_id", *keep, words("text").alias("words"))
        rows = cut.select(
            "doc_id", *keep, F.size("words").alias("n_words"),
            F.posexplode_outer(F.slice("words", 1, limit)).alias("at_word", "word"),
        )
    # One id more than fits tells a truncated row.
    with_ids = pieces_of_rows(rows, "doc_id", vocab, specials.unk, carry, limit + 1, broadcast_bytes)
    framed = frame_ids(F.col("ids"), max_len, specials.cls, specials.sep)
    return with_ids.withColumn("framed", framed).select(
        "doc_id",
        *carry,
        ((F.col("n_words") > limit) | (F.size("ids") > limit)).alias("truncated"),
        pad_right(F.col("framed"), max_len, specials.pad).alias("token_ids"),
        mask(F.size("framed"), max_len).alias("attention_mask"),
    )


def encode_with(df: DataFrame, encode_batch, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode with a caller's tokenizer, one Arrow batch of texts at a time.

    ``encode_batch`` takes a list of texts and returns a list of (ids, mask).
    """
    kept = df.select("doc_id", *keep)
    schema = kept.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    columns = kept.columns

    def run(frames):
        for frame in frames:
            out = frame[columns].copy()
            encoded = encode_batch(frame["text"].tolist())
            out["token_ids"] = [list(ids) for ids, _ in encoded]
            out["attention_mask"] = [list(bits) for _, bits in encoded]
            yield out

    return df.select("doc_id", *keep, "text").mapInPandas(
        run, f"{schema}, token_ids array<int>, attention_mask array<int>"
    )


def truncation_report(encoded: DataFrame) -> DataFrame:
    """Share of rows that lose text to the length limit, per split and label."""
    return encoded.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("truncated").cast("int")).alias("n_truncated"),
        F.avg(F.col("truncated").cast("int")).alias("share_truncated"),
    )
