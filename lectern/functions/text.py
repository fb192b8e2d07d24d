"""Column expressions over text. All of them stay inside the JVM."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a regular-expression class body.
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Punctuation as the published uncased tokenizer defines it
# (every ASCII symbol, plus the Unicode punctuation categories).
PUNCTUATION_CLASS = r"!-/:-@\[-`{-~\p{P}"
# Code point blocks the same tokenizer isolates character by character.
IDEOGRAPH_CLASS = (
    r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}"
    r"\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}"
)
# The patterns below put a cheap range test in front of each class (``&&`` intersects),
# so that ordinary letters are decided by one or two comparisons.
_BEYOND_ASCII = r"\x{80}-\x{10ffff}"
BLANK = rf"[\x00-\x20\x{{85}}-\x{{3000}}&&[{WHITESPACE_CLASS}]]"
_NOT_BLANK = rf"[\x21-\x7e[^{WHITESPACE_CLASS}]]"
# Control, format, private and unassigned characters other than tab and line breaks,
# and the replacement character: removed before splitting.
_CONTROL = rf"[\x00-\x1f\x7f{_BEYOND_ASCII}&&[\x{{fffd}}[^\P{{C}}\t\n\r]]]"
_ALONE = rf"[!-/:-@\[-`{{-~[{_BEYOND_ASCII}&&[{PUNCTUATION_CLASS}{IDEOGRAPH_CLASS}]]]"
_WORD_CHAR = (
    rf"[a-zA-Z0-9[{_BEYOND_ASCII}&&[^{PUNCTUATION_CLASS}{IDEOGRAPH_CLASS}{WHITESPACE_CLASS}]]]"
)


def strip(text) -> Column:
    """Remove Unicode whitespace from both ends; a null text counts as empty."""
    return F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITESPACE))


def tokens(stripped) -> Column:
    """Split an already stripped text on whitespace runs; no empty tokens."""
    empty = F.array().cast("array<string>")
    return F.when(F.col(stripped) == "", empty).otherwise(F.split(stripped, f"{BLANK}+"))


def n_tokens(stripped) -> Column:
    return F.size(tokens(stripped))


def has_tokens(stripped, n: int) -> Column:
    """At least ``n`` tokens. Stops at the n-th, where ``n_tokens`` reads the whole text."""
    if n <= 0:
        return F.lit(True)
    return F.col(stripped).rlike(f"^(?:{_NOT_BLANK}++{BLANK}++){{{n - 1}}}{_NOT_BLANK}")


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks."""
    accented, base = [], []
    for point in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(point))
        bare = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != chr(point):
            accented.append(chr(point))
            base.append(bare[0])
    return "".join(accented), "".join(base)


def normalise(text, fold_accents: bool = True) -> Column:
    """Drop control characters, lower-case, and fold accented letters to their base."""
    lowered = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _CONTROL, ""))
    if not fold_accents:
        return lowered
    accented, base = _accent_map()
    folded = F.regexp_replace(F.translate(lowered, accented, base), r"[\x{300}-\x{10ffff}&&\p{Mn}]+", "")
    # A text of one byte per character holds no accent: skip the per-character pass.
    is_ascii = F.length(text) == F.octet_length(text)
    return F.when(is_ascii, lowered).otherwise(folded)


def words(text, fold_accents: bool = True) -> Column:
    """Normalised words in order; every punctuation mark and ideograph is its own word."""
    pattern = F.lit(f"{_WORD_CHAR}+|{_ALONE}")
    return F.regexp_extract_all(normalise(text, fold_accents), pattern, F.lit(0))
