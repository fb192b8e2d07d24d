"""Ids of words that were spelled before, found by the words' bytes in arrays."""

from collections.abc import Callable

import numpy as np

U = np.uint64
# Words up to this size are found by their bytes as two numbers, the last byte being the size.
SHORT_BYTES = 15
# Zero bytes that must follow the text that words lie in.
PADDING = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Slots for each short word, at least.
_ROOM = 4


def run_places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs of ``count`` places, each from its ``first``, one run after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class WordTable:
    """Remembers the ids of words. ``spell`` turns the bytes of distinct words, one after
    another, and their sizes into all their ids and the number of ids of each."""

    def __init__(self, spell: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.spell = spell
        self.clear()

    def clear(self) -> None:
        # Entry 0 stands for an empty slot; no word has its size. The arrays have room to grow.
        self.low, self.high = np.zeros(1, U), np.zeros(1, U)
        self.first, self.count = np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.n_entries, self.n_ids = 1, 0
        self.slots = np.zeros(1 << 12, np.int32)
        self.long: dict[bytes, int] = {}
        self.n_short = 0
        self.long_bytes = 0

    @property
    def n_bytes(self) -> int:
        """Memory taken, about."""
        arrays = (self.low, self.high, self.first, self.count, self.pool, self.slots)
        return sum(a.nbytes for a in arrays) + self.long_bytes + 150 * len(self.long)

    def ids(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at ``begin`` of ``data``, and the number of each word's ids.
        Sizes are 1 or more."""
        entry = self._entries(data, begin, size)
        count = self.count[entry].astype(np.int64)
        return self.pool[run_places(self.first[entry], count)], count

    def _entries(self, data, begin, size):
        entry = np.zeros(len(begin), np.int64)
        short = np.flatnonzero(size <= SHORT_BYTES)
        low, high = _numbers(data, begin[short], size[short])
        found = self._find(low, high)
        fresh = np.flatnonzero(found == 0)
        # One place of each new short word.
        order = fresh[np.lexsort((high[fresh], low[fresh]))]
        differs = np.ones(len(order), bool)
        differs[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        new = order[differs]
        found[order] = self.n_entries + np.cumsum(differs) - 1
        entry[short] = found
        where, next_entry = [short[new]], self.n_entries + len(new)
        if len(short) < len(begin):
            longer, more = np.flatnonzero(size > SHORT_BYTES), []
            for i, at, n in zip(longer.tolist(), begin[longer].tolist(), size[longer].tolist()):
                word = data[at : at + n].tobytes()
                known = self.long.get(word)
                if known is None:
                    known = self.long[word] = next_entry + len(more)
                    more.append(i)
                    self.long_bytes += n
                entry[i] = known
            where.append(np.array(more, np.int64))
        where = np.concatenate(where)
        if len(where):
            self._learn(data, begin[where], size[where], low[new], high[new])
        return entry

    def _learn(self, data, begin, size, low, high):
        """Spell distinct words; the first of them are the short ones that ``low, high`` tell."""
        ids, count = self.spell(data[run_places(begin, size)], size)
        old, n_ids = self.n_entries, self.n_ids
        self.low, self.high = _put(self.low, old, low), _put(self.high, old, high)
        self.n_entries += len(size)
        self.n_ids += len(ids)
        # A long word's numbers stay 0.
        others = np.zeros(len(size) - len(low), U)
        self.low, self.high = _put(self.low, old + len(low), others), _put(self.high, old + len(low), others)
        self.first = _put(self.first, old, n_ids + np.cumsum(count) - count)
        self.count = _put(self.count, old, count)
        self.pool = _put(self.pool, n_ids, ids)
        self.n_short += len(low)
        entries = np.arange(old, old + len(low), dtype=np.int32)
        if self.n_short * _ROOM > len(self.slots):
            self.slots = np.zeros(1 << (2 * _ROOM * self.n_short).bit_length(), np.int32)
            entries = np.flatnonzero(self.high[: self.n_entries]).astype(np.int32)
        slot, mask = self._slot(self.low[entries], self.high[entries]), len(self.slots) - 1
        while len(entries):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entries[free]
            rest = self.slots[slot] != entries
            entries, slot = entries[rest], (slot[rest] + 1) & mask

    def _slot(self, low, high):
        mixed = low * U(0x9E3779B97F4A7C15) + high * U(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> U(32)
        mixed *= U(0xD6E8FEB86659FD93)
        return (mixed >> U(65 - len(self.slots).bit_length())).view(np.int64)

    def _find(self, low, high):
        """The entries of short words, 0 for those that are not known."""
        slot = self._slot(low, high)
        found = self.slots[slot].astype(np.int64)
        rest = np.flatnonzero((self.low[found] != low) | (self.high[found] != high))
        # Those in an empty slot are not known; others may be in one of the next.
        rest = rest[found[rest] > 0]
        mask = len(self.slots) - 1
        while len(rest):
            slot[rest] = (slot[rest] + 1) & mask
            found[rest] = self.slots[slot[rest]]
            at = found[rest]
            rest = rest[(at > 0) & ((self.low[at] != low[rest]) | (self.high[at] != high[rest]))]
        return found


def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` at place ``at``, twice as large where there is no room."""
    if at + len(more) > len(held):
        held = np.concatenate([held[:at], np.zeros(at + 2 * len(more), held.dtype)])
    held[at : at + len(more)] = more
    return held


def _numbers(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words of up to 15 bytes as two numbers, with the size in the last byte."""
    two = data[:-1] | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2] | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4] | four[4:].astype(U) << U(32)
    low = eight[begin] & _MASK[np.minimum(size, 8)]
    high = eight[begin + 8] & _MASK[np.maximum(size - 8, 0)]
    return low, high | size.astype(U) << U(56)
