"""Words of many texts at once: their places and 64-bit hashes, from the raw bytes.

A hash of a word is a polynomial in its bytes modulo 2**64, mixed afterwards; all words
of a piece of text come from one running sum. Equal hashes are taken as candidates where
an operator promises exact results, and texts are compared there.
"""

from hashlib import blake2b

import numpy as np

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)
# Bytes that byte-level arrays are built for at once.
PIECE = 1 << 20
# Polynomials modulo 2**64 are equal for some words of 1,024 bytes and more that differ,
# whatever the base; ``strengthened`` hashes words beyond this length another way.
POLYNOMIAL_BYTES = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Word characters of the contracts, as bytes of UTF-8.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[0x30:0x3A] = LETTERS_DIGITS[0x41:0x5B] = LETTERS_DIGITS[0x61:0x7B] = True
LETTERS_DIGITS[0x80:] = True

_CODE_OF_LOWER = _BYTE_CODE[LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U(salt * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + (1 << 16)), U(base))
        have[0] = 1
        _powers[name] = np.multiply.accumulate(have)
    return _powers[name][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of the codes' terms; ``codes`` is overwritten."""
    sums = np.zeros(len(codes) + 1, U)
    codes *= _power("base", _BASE, len(codes))
    np.cumsum(codes, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of byte spans from their prefix sums."""
    return (sums[ends] - sums[begins]) * _power("inverse", _INVERSE, len(sums))[begins]


def _cuts(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> list[int]:
    """Places that no word spans, about ``PIECE`` bytes apart (a longer word stays whole)."""
    cuts, at, n = [0], 0, len(data)
    while n - at > PIECE:
        at += PIECE
        near = int(starts[min(np.searchsorted(starts, at), len(starts) - 1)])
        while at < n:
            gap = np.flatnonzero(~is_word[data[at : at + 65536]])
            if len(gap):
                at += int(gap[0])
                break
            at += 65536
        at = min(at, near, n) if near >= cuts[-1] + PIECE else min(at, n)
        cuts.append(at)
    return cuts + [n] if cuts[-1] < n else cuts


def hashed_words(
    data: np.ndarray, starts: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``begin, end, hash`` of each word with ASCII letters folded, and the index of each
    text's first word (one more entry than texts)."""
    begins, ends, hashes = [], [], []
    cuts = _cuts(data, starts, is_word)
    for low, high in zip(cuts, cuts[1:]):
        piece = data[low:high]
        inside = is_word[piece]
        first = np.searchsorted(starts, low)
        edges = starts[first : np.searchsorted(starts, high)] - low
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        closes[before] = inside[before]
        b, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = prefix_sums(_CODE_OF_LOWER[piece])
        hashes.append(mix(span_hashes(sums, b, e) + (e - b).astype(U) * _GOLD))
        begins.append(b + low)
        ends.append(e + low)
    if not begins:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), np.zeros(len(starts), np.int64)
    begin = np.concatenate(begins)
    return begin, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(begin, starts)


def strengthened(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``hashes`` of words with those of long words replaced by BLAKE2b of their folded bytes."""
    out = hashes.copy()
    for i in np.flatnonzero(end - begin > POLYNOMIAL_BYTES):
        digest = blake2b(LOWER[data[begin[i] : end[i]]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, one for each possible first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(size):
        total = total * U(_BASE) + words[j : j + n]
    return mix(total + U(size))


def sequence_hash(words: np.ndarray) -> np.uint64:
    return sequence_hashes(words, len(words))[0]


def shingles(
    words: np.ndarray, first: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and the text of each, ordered by text.

    A text with fewer words, but not none, has the whole sequence as its only shingle.
    """
    count = np.diff(first)
    every = sequence_hashes(words, size)
    text = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    base = np.repeat(first[:-1], np.maximum(count - size + 1, 0))
    within = np.arange(len(text)) - np.repeat(
        np.cumsum(np.maximum(count - size + 1, 0)) - np.maximum(count - size + 1, 0),
        np.maximum(count - size + 1, 0),
    )
    found = every[base + within] if len(text) else np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([sequence_hash(words[first[i] : first[i + 1]]) for i in short], U)
        found, text = np.concatenate([found, extra]), np.concatenate([text, short])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[keep], text[keep]
