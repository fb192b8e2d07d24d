import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from plain import SF, docs_of, edge_rows
from tokenizers import Tokenizer

from lectern.llm import byte_bpe, merges, token_counts
from lectern.llm.merges import PairTable, merge
from lectern.llm.pretokens import BYTE_PATTERN, Splitter
from lectern.llm.queries import BYTE_RANKS, WORD_BPE

ODD = [
    "", "   ", "ΑΣΣ ΣΑΣ İstanbul ǅ", "a" * 3000 + " b", "x<|endoftext|>y <|startoftext|><|endoftext|>",
    "\x1c\x1d \x85   it's we'll I'M 'S don't 123 1²½", "日本語テキスト\U0001f600\U0001f468‍\U0001f469" * 3, "ﬁ ﬀ é ẞ STRASSE ß",
    "thethethethe" * 500, "\r\n\n  \t x  \n", "ab" * 700 + "abcde" * 99,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("abcdeéß '\n 1!日") for _ in range(rng.randint(1, 500))) for _ in range(150)]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts(spark, texts):
    published = Tokenizer.from_file(WORD_BPE)
    rows = [(i, t) for i, t in enumerate(texts)] + edge_rows()
    found = token_counts.count_tokens(docs_of(spark, rows), WORD_BPE).select("doc_id", "text", "tokens.*").collect()
    assert len(found) == len(rows)
    for r in found:
        n = len(published.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 2048)


def test_round_trip(spark, texts, library):
    rows = [(i, t) for i, t in enumerate(texts)] + edge_rows()
    coded = byte_bpe.round_trip(docs_of(spark, rows), BYTE_RANKS, public_tokenizers.PATTERN)
    found = coded.select("doc_id", "text", "bpe.*").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_digests(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = dict(tuple(r) for r in docs.collect())
    coded = byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    for r in byte_bpe.digests(coded).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert token_counts.count_tokens(none, WORD_BPE).count() == 0
    assert byte_bpe.digests(byte_bpe.round_trip(none, BYTE_RANKS, public_tokenizers.PATTERN)).count() == 0


def test_fold_by_higher_order_functions(spark):
    pieces = [bytes([b]) for b in range(256)] + [b"th", b"in", b"the", b"an", b"ing", b" a", b" an", b"aa", "é".encode()]
    ranks = {piece: rank for rank, piece in enumerate(pieces)}
    plain = tiktoken.Encoding("small", pat_str=r"\S+| ", mergeable_ranks=ranks, special_tokens={})
    words = ["the", "thing", " an", "aaaaa", "été", "x", "thinthe"]
    found = byte_bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks, buckets=64)
    bpe = byte_bpe.ByteBpe(ranks, r"(?s:.+)")
    for r in found.collect():
        assert r.ids == bpe.encode([r.word])[0].tolist()
        if " " not in r.word:
            assert r.ids == plain.encode_ordinary(r.word)


def test_long_words(library):
    rng = random.Random(8)
    text = " ".join(line for line in open(byte_bpe.__file__, encoding="utf-8"))
    known = [w for w in text.split() if w.isalpha()]
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (300, 400, 1000, 5000) for _ in range(8)]
    words += ["".join(rng.choice(known) for _ in range(n // 4)) for n in (300, 400, 1000, 5000) for _ in range(8)]
    words += ["".join(rng.choice("ab") for _ in range(n)) for n in (200, 256, 257, 700)]
    published = Tokenizer.from_file(WORD_BPE)
    counter = token_counts.WordBpe(WORD_BPE)
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(BYTE_RANKS), public_tokenizers.PATTERN)
    for word in words:
        assert bpe.encode([word])[0].tolist() == library.encode_ordinary(word)
        assert counter.count([word]) == [len(published.encode(word, add_special_tokens=False).ids)]


@pytest.mark.parametrize("times", [1, 100])
def test_lowest_rank_first(times):
    """A pair made by a merge may rank before a neighbour's, in words of any length."""
    w, x, a, b, q, wx, wxa, ab, xa = range(9)
    table = PairTable([w, wx, a, x], [x, a, b, a], [1, 3, 5, 10], [wx, wxa, ab, xa])
    symbols, counts = merge(np.tile([w, x, a, b, q], times), np.array([5 * times]), table)
    assert symbols.tolist() == [wxa, b, q] * times and counts.tolist() == [3 * times]


@pytest.mark.parametrize("pad", [0, 300])
def test_one_of_equal_pairs_first(pad):
    """Merging one of two equal pairs may make a pair that takes the other's letter."""
    a, b, q, ab, aba = range(5)
    table = PairTable([a, ab], [b, a], [5, 2], [ab, aba])
    symbols, _ = merge(np.array([a, b, a, b] + [q] * pad), np.array([4 + pad]), table)
    assert symbols.tolist() == [aba, b] + [q] * pad


def test_checked_ids(spark, texts, library):
    rows = [(i, t) for i, t in enumerate(texts)] + edge_rows()
    docs = docs_of(spark, rows).withColumnRenamed("language", "bpe")
    found = byte_bpe.encode_checked(docs, BYTE_RANKS, public_tokenizers.PATTERN).select("text", "bpe.*", "n_tokens").collect()
    assert len(found) == len(rows)
    assert all(r.ids == library.encode_ordinary(r.text or "") and r.same and r.n_tokens == "y" for r in found)
    assert byte_bpe.encode_checked(docs_of(spark, []), BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_letters_of_newer_unicode_versions():
    published = Tokenizer.from_file(WORD_BPE)
    counter, ids = token_counts.WordBpe(WORD_BPE), token_counts.WordIds(WORD_BPE)
    for text in ["aꟋb", "Ꟛ x Ꟛꟛ", "\U00032808", "x \U0003d85c<|endoftext|>y", "￿\U000e0080"]:
        want = published.encode(text, add_special_tokens=False).ids
        assert counter.count([text]) == [len(want)]
        assert np.frombuffer(ids.encode([text])[0], "<u4").tolist() == want


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 10_000)
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(BYTE_RANKS), public_tokenizers.PATTERN)
    for n in range(50):
        bpe.encode([" ".join(f"w{n}x{i}" for i in range(50))])
    assert sum(len(w) for w in bpe.known) < 20_000


PIECES = ["'", "s", "re", "ll", "d", "v", "B", "É", "ß", "İ", "Ɓ", "0", "²", " ", "\n", "\x1c", "\x00", "\x85", "\xa0", "　", "-", "×", "日本", "Σ", "́", "😀", "<|endoftext|>", "<|", "a" * 15, "a" * 16, "é" * 8, "я"]


def test_ids_of_odd_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "CODED_LETTERS", 40)
    published, coder = Tokenizer.from_file(WORD_BPE), token_counts.WordIds(WORD_BPE)
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(60))) for _ in range(1500)]
    texts += ["", "'", "'s", "''s", "x's's", "x'", "'l", "'v", "'r e", "\x00", "\x00\x00", "a\x00"]
    for low in range(0, len(texts), 200):
        group = texts[low : low + 200]
        want = [published.encode(t, add_special_tokens=False).ids for t in group]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(group)] == want


def test_plain_texts_make_no_words():
    """Words of plain texts are found in their bytes, and each is spelled once."""
    published, coder = Tokenizer.from_file(WORD_BPE), token_counts.WordIds(WORD_BPE)
    coder.words = None
    spelled, spell = [], coder.spell
    coder.table_of_words.spell = lambda raw, sizes: spelled.append(len(sizes)) or spell(raw, sizes)
    text = "It's 1984, naïve élan; WE'LL SEE... " * 3 + "x" * 40
    for texts in ([text], [text, text + " again"]):
        want = [published.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)] == want
    assert sum(spelled) == len(set(Splitter(BYTE_PATTERN)(coder.normal(text)))) + 1


def test_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 100_000)
    coder = token_counts.WordIds(WORD_BPE)
    sizes = []
    for n in range(60):
        coder.encode([" ".join(f"{a}{b}{n % 7}w {a}{b}{'long' * 5}" for a in "abcdefgh" for b in "klmnopqrst")])
        sizes.append(coder.table_of_words.n_bytes)
    assert max(sizes) < 200_000


@pytest.mark.parametrize("block", [1, 300, 1 << 16])
def test_words_merged_at_once_and_alone(monkeypatch, block):
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = [bytes(rng.choices(b"aabetion 's", k=n)) for n in [*range(1, 40), 255, 256, 257] * 3] + [b"a" * n for n in range(1, 60)]
    rng.shuffle(words)
    symbols, sizes = bpe.bytes[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words])
    monkeypatch.setattr(merges, "LONG_WORD", 1)
    alone = merge(symbols, sizes, bpe.table)
    monkeypatch.setattr(merges, "LONG_WORD", 256)
    monkeypatch.setattr(merges, "BLOCK_LETTERS", block)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(merges.np, "searchsorted", lambda a, v, *more: searched.append(np.size(v)) or search(a, v, *more))
    at_once = merge(symbols, sizes, bpe.table)
    assert all(np.array_equal(a, b) for a, b in zip(alone, at_once))
    # Pairs were looked up by bisection, for each letter and again after each merge.
    assert sum(searched) < len(symbols) / 2
