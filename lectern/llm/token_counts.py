"""Token counts of whole texts under a word-end BPE vocabulary (a tokenizers ``.json``)."""

import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.batches import annotate, longs, per_text
from lectern.llm.byte_bpe import groups_of_texts
from lectern.llm.merges import PairTable, merge
from lectern.llm.pretokens import BYTE_PATTERN, Splitter, plain, plain_spans
from lectern.llm.wordtable import PADDING, WordTable

# Bytes of words and their ids that a task remembers, about.
REMEMBERED_BYTES = 64 << 20
# The same of a table of words in arrays.
TABLE_BYTES = 32 << 20
# Letters that are coded at once; a text without spaces may be longer.
CODED_LETTERS = 1 << 20
# What an entry takes beside its letters and ids, about.
_ENTRY = 150


def _byte_letters() -> list[str]:
    """The printable letter that the published byte-level step writes for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def _unknown_letters() -> re.Pattern:
    """Code points that this Python's Unicode version does not know; a library's may."""
    ranges, first = [], None
    for c in range(0x80, sys.maxunicode + 2):
        unknown = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if unknown and first is None:
            first = c
        elif not unknown and first is not None:
            ranges.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return re.compile(f"[{''.join(ranges)}]")


class WordBpe:
    """Counts tokens as the vocabulary file says: special strings, normal form, words, merges.

    Texts with code points that Python's Unicode version lacks go to the published library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as text:
            spec = json.load(text)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(map(_pair, spec["model"]["merges"]))]
        self.table = PairTable(*zip(*pairs))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = Splitter(split)
        # Whether the words of plain texts can be told by their bytes.
        self.by_bytes = split == BYTE_PATTERN
        self.known: dict[str, int] = {}
        self.held = 0
        self.library = None

    def normal(self, text: str) -> str:
        if not text.isascii():
            # The file's lower-casing goes letter by letter, so a final sigma is an ordinary one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, text: str) -> tuple[int, list[str]]:
        """Special strings found, and the words between them. White space only parts words."""
        if self.special is None or "<|" not in text:
            return 0, self.words(self.normal(text))
        parts = self.special.split(text)
        return len(parts) - 1, [w for part in parts for w in self.words(self.normal(part))]

    def spell(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words whose bytes lie one after another, and the number of each one's."""
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        return merge(symbols, sizes, self.table)

    def learn(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(coded), np.uint8)
        _, counts = self.spell(raw, np.array([len(b) for b in coded]))
        self.known.update(zip(words, counts.tolist()))
        self.held += len(raw) + _ENTRY * len(words)

    def unsure(self, text: str) -> bool:
        return not plain(text) and _unknown_letters().search(text) is not None

    def published(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def count(self, texts: list[str]) -> list[int]:
        found = [(len(self.published(t)), []) if self.unsure(t) else self.split(t) for t in texts]
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        fresh = set().union(*(w for _, w in found)).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [n + sum(map(known, w)) for n, w in found]


class WordIds(WordBpe):
    """The ids themselves, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as text:
            added = json.load(text)["added_tokens"]
        self.special_ids = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.table_of_words = WordTable(self.spell)

    def spans(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that hold the words of normal texts, ``begin`` and ``size`` of each word, and
        the index of each text's first word (one more entry than texts)."""
        easy = [self.by_bytes and plain(piece) for piece in pieces]
        coded = [piece.encode() for piece, e in zip(pieces, easy) if e]
        # White space between texts parts their words.
        body = b" ".join(coded)
        begin, size = plain_spans(np.frombuffer(body, np.uint8))
        before = np.cumsum([0, *(len(c) + 1 for c in coded)])
        first = np.searchsorted(begin, before)
        if len(coded) < len(pieces):
            words = [[] if e else [w.encode() for w in self.words(piece)] for piece, e in zip(pieces, easy)]
            more = [w for found in words for w in found]
            sizes = np.array([len(w) for w in more], np.int64)
            order = np.argsort(~np.array(easy), kind="stable")
            n_words = np.array([len(w) for w in words])
            n_words[easy] = np.diff(first)
            # Words of the plain texts lie before all others; they are put in the texts' order.
            place = np.zeros(len(pieces), np.int64)
            place[order] = np.cumsum(n_words[order]) - n_words[order]
            begin = np.r_[begin, len(body) + np.cumsum(sizes) - sizes]
            size = np.r_[size, sizes]
            first = np.r_[0, np.cumsum(n_words)]
            taken = np.repeat(place - first[:-1], n_words) + np.arange(len(begin))
            begin, size = begin[taken], size[taken]
            body += b"".join(more)
        return np.frombuffer(body + bytes(PADDING), np.uint8), begin, size, first

    def coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of normal texts, which are told by arrays over all their bytes."""
        if self.table_of_words.n_bytes > TABLE_BYTES:
            self.table_of_words.clear()
        data, begin, size, first = self.spans(pieces)
        ids, count = self.table_of_words.ids(data, begin, size)
        raw = ids.astype("<u4").tobytes()
        stops = (np.r_[0, np.cumsum(count)][first] * 4).tolist()
        return [raw[low:high] for low, high in zip(stops, stops[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, special strings in it included."""
        unsure = [self.unsure(t) for t in texts]
        special = [[] if u or self.special is None or "<|" not in t else self.special.findall(t) for t, u in zip(texts, unsure)]
        pieces, n_pieces = [], []
        for text, marks, u in zip(texts, special, unsure):
            for part in [] if u else self.special.split(text) if marks else [text]:
                found = cut_at_spaces(self.normal(part))
                pieces += found
                n_pieces.append(len(found))
        coded, group, held = [], [], 0
        for piece in pieces:
            if group and held + len(piece) > CODED_LETTERS:
                coded += self.coded(group)
                group, held = [], 0
            group.append(piece)
            held += len(piece)
        coded += self.coded(group)
        rest = iter(coded)
        parts = iter([b"".join(islice(rest, n)) for n in n_pieces])
        out = []
        for text, marks, u in zip(texts, special, unsure):
            if u:
                out.append(np.array(self.published(text), "<u4").tobytes())
            else:
                out.append(b"".join([next(parts), *(x for mark in marks for x in (self.special_ids[mark], next(parts)))]))
        return out


def cut_at_spaces(text: str) -> list[str]:
    """A long text in parts of about ``CODED_LETTERS`` that begin with a space."""
    out, at = [], 0
    while len(text) - at > CODED_LETTERS and (stop := text.find(" ", at + CODED_LETTERS)) >= 0:
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def _pair(merge_rule):
    return merge_rule.split(" ") if isinstance(merge_rule, str) else merge_rule


@lru_cache(maxsize=2)
def counter(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def id_coder(path: str) -> WordIds:
    return WordIds(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, name: str = "tokens") -> DataFrame:
    """``docs`` with ``name``: struct of ``n_bytes, n_tokens, over_limit``.

    Null and empty texts have no tokens. Texts are never cut; other columns and repeated
    rows pass unchanged, an older column ``name`` is replaced.
    """

    def start():
        bpe = counter(path)

        def work(texts):
            n_bytes, n_tokens = [], []
            for group in groups_of_texts(texts):
                n_bytes += [len(t) if t.isascii() else len(t.encode()) for t in group]
                n_tokens += bpe.count(group)
            over = np.asarray(n_tokens, np.int64) > limit
            return {"n_bytes": longs(n_bytes), "n_tokens": longs(n_tokens), "over_limit": pa.array(over)}

        return work

    return annotate(docs, name, per_text(start, "struct<n_bytes:bigint,n_tokens:bigint,over_limit:boolean>"))
