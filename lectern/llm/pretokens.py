r"""Splitting texts by a published pattern written with ``\p{L}``, ``\p{N}``, ``\s``, ``\S``."""

import re

import numpy as np
import regex

# Letters of the alphabet that the standard module can split by explicit ranges.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CLASS = {r"\p{L}": _LETTERS, r"\p{N}": "0-9", r"\s": r"\t-\r\x20"}
_PLAIN = re.compile(f"[\x00-\x7f{_LETTERS}]*").fullmatch


def unicode_spaces(pattern: str) -> str:
    r"""``\s`` and ``\S`` as the Unicode property that the published libraries mean."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _explicit(pattern: str) -> str:
    out, at, inside = "", 0, False
    while at < len(pattern):
        name = next((c for c in _CLASS if pattern.startswith(c, at)), None)
        if name:
            out += _CLASS[name] if inside else f"[{_CLASS[name]}]"
            at += len(name)
        elif pattern.startswith(r"\S", at):
            out += f"[^{_CLASS[chr(92) + 's']}]"
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out += pattern[at]
            at += 1
    return out


def plain(text: str) -> bool:
    """Whether all letters are of the alphabet with explicit ranges."""
    return text.isascii() or _PLAIN(text) is not None


# The pattern whose matches ``plain_spans`` finds in bytes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT


def plain_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``begin, size`` of all matches of ``BYTE_PATTERN`` in the UTF-8 bytes of plain text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = kind == _DIGIT
    edge[1:] |= kind[1:] != kind[:-1]
    edge[0] = True
    begin = np.flatnonzero(edge)
    of, end = kind[begin], np.r_[begin[1:], len(data)]
    # A quote alone before letters takes the first of them where they are an ending's.
    quote = np.flatnonzero((data[begin] == ord("'")) & (end - begin == 1))
    quote = quote[quote + 1 < len(begin)]
    quote = quote[of[quote + 1] == _LETTER]
    at = begin[quote + 1]
    one, two = data[at], np.where(end[quote + 1] - at > 1, data[np.minimum(at + 1, len(data) - 1)], 0)
    taken = np.isin(one, list(b"stmd")).astype(np.int64)
    taken[(two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))] = 2
    end[quote] += taken
    begin[quote + 1] += taken
    kept = (of != _SPACE) & (begin < end)
    return begin[kept], (end - begin)[kept]


class Splitter:
    """All matches of a pattern; Latin texts take the standard module's faster scan."""

    def __init__(self, pattern: str):
        self.full = regex.compile(unicode_spaces(pattern)).findall
        self.plain = re.compile(_explicit(pattern)).findall

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if plain(text) else self.full(text)
