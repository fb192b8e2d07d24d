"""Byte-pair merges of many words at once on ragged arrays."""

from array import array
from heapq import heapify, heappop, heappush

import numpy as np

# No pair; above the rank and result of any.
NEVER = np.int64((1 << 63) - 1)
# A symbol that was merged into the one before it.
_GONE = -2
# Where a pair's number has its rank, and, while words are merged, its place in the word.
_RANK, _PLACE = 40, 32


class PairTable:
    """Rank and result of each mergeable pair of symbol ids, looked up by hash."""

    def __init__(self, left, right, rank, result):
        key = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        # Ranks are numbered anew, so that each leaves room for a place and a result.
        order = np.unique(np.asarray(rank, np.int64), return_inverse=True)[1].astype(np.int64)
        # The last entry is that of an empty slot.
        self.key = np.r_[key, np.iinfo(np.int64).min]
        self.value = np.r_[order << _RANK | np.asarray(result, np.int64), NEVER]
        bits = max(8, (8 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, len(key), np.int32)
        wanted, rest = self._slot(key), np.arange(len(key), dtype=np.int32)
        while len(rest):
            at = wanted[rest]
            free = self.slots[at] == len(key)
            self.slots[at[free]] = rest[free]
            rest = rest[self.slots[at] != rest]
            wanted[rest] = (wanted[rest] + 1) & (len(self.slots) - 1)
        self._pairs = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    @property
    def pairs(self) -> dict[int, int]:
        """Rank and result in one number by the pair's key; built for the first long word."""
        if self._pairs is None:
            self._pairs = dict(zip(self.key[:-1].tolist(), self.value[:-1].tolist()))
        return self._pairs

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 40 | result`` of each pair, ``NEVER`` for one that does not merge."""
        key = left << 32 | right
        slot = self._slot(key)
        entry = self.slots[slot]
        same = self.key[entry] == key
        found = np.where(same, self.value[entry], NEVER)
        rest = np.flatnonzero(~same & (entry < len(self.key) - 1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            entry = self.slots[slot[rest]]
            same = self.key[entry] == key[rest]
            found[rest[same]] = self.value[entry[same]]
            rest = rest[~same & (entry < len(self.key) - 1)]
        return found


# A longer word is merged by itself with a heap: its rounds would be about as many as its
# letters, each over all of them. The results are the same.
LONG_WORD = 256
# Letters of words of like lengths that are merged at once, about.
BLOCK_LETTERS = 1 << 16


def merge(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge each sequence to the end: always its lowest-rank pair, the leftmost of equals.

    Sequences up to ``LONG_WORD`` are merged many at once, one pair of each in a round,
    longer ones one by one. ``symbols`` holds the sequences one after another, ``sizes``
    their lengths (1 or more). Returns the surviving symbols and their number for each
    sequence.
    """
    n, sizes = len(symbols), np.asarray(sizes, np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    # A merged symbol stays at its left part's place. Beyond the last one lies what no pair has.
    held = np.r_[np.asarray(symbols, np.int64), _GONE]
    starts = np.cumsum(sizes) - sizes
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[starts + sizes - 1] = n
    before[starts] = n
    value = table.find(held[:-1], held[after[:-1]])
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    low, short = np.searchsorted(ordered, [2, LONG_WORD + 1])
    for word in order[short:].tolist():
        own = slice(starts[word], starts[word] + sizes[word])
        merged = _merge_long(held[own], table)
        held[own] = _GONE
        held[own.start : own.start + len(merged)] = merged
    while low < short:
        most = min(ordered[low] * 3 // 2 + 2, LONG_WORD)
        high = min(low + max(1, BLOCK_LETTERS // most), short, np.searchsorted(ordered, most, "right"))
        _merge_block(held, after, before, value, starts[order[low:high]], ordered[low:high], table)
        low = high
    kept = held[:-1] != _GONE
    return held[:-1][kept], np.add.reduceat(kept, starts, dtype=np.int64)


def _merge_block(held, after, before, value, starts, sizes, table: PairTable) -> None:
    """Merge the words at ``starts``; ``held, after, before`` are all words' symbols and
    neighbours and are changed in place, ``value`` tells the pairs that start at each symbol."""
    width, last = int(sizes.max()), len(held) - 1
    places = np.arange(width)[:, None]
    # Pairs by place in the word; a last row takes those of words that have no symbol before.
    pair = np.full((width + 1, len(starts)), NEVER)
    inside = places < sizes
    pair[:-1][inside] = value[(starts + places)[inside]]
    pair[:-1] |= np.where(pair[:-1] < NEVER, places << _PLACE, 0)
    while True:
        lowest = pair[:-1].min(axis=0)
        live = np.flatnonzero(lowest < NEVER)
        if not len(live):
            return
        if 2 * len(live) < len(starts):
            # The others have ended.
            pair, starts, lowest = pair.take(live, axis=1), starts[live], lowest[live]
            live = np.arange(len(live))
        words, flat, lowest, start = len(starts), pair.reshape(-1), lowest[live], starts[live]
        place = lowest >> _PLACE & (1 << _RANK - _PLACE) - 1
        made = lowest & (1 << _PLACE) - 1
        at = start + place
        gone = after[at]
        right, left = after[gone], before[at]
        held[at], held[gone] = made, _GONE
        after[at], before[right] = right, at
        place_before = np.where(left < last, left - start, width)
        found = table.find(np.r_[made, held[left]], np.r_[held[right], made])
        found |= np.where(found < NEVER, np.r_[place, place_before] << _PLACE, 0)
        flat[(gone - start) * words + live] = NEVER
        flat[place * words + live] = found[: len(live)]
        flat[place_before * words + live] = found[len(live) :]


def _merge_long(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """One sequence: a heap of (rank, place) over linked neighbours."""
    n = len(symbols)
    found = table.find(symbols[:-1], symbols[1:])
    known = np.flatnonzero(found < NEVER)
    rank = found >> _RANK
    heap = (rank[known] << 32 | known).tolist()
    heapify(heap)
    # Rank of the pair that starts at each place now; an entry of another rank is stale.
    now = array("q", rank.tobytes())
    now.append(-1)
    held = array("q", symbols.tobytes())
    after = array("q", range(1, n + 1))
    before = array("q", range(-1, n - 1))
    pairs = table.pairs

    def renew(at, left, right):
        pair = pairs.get(left << 32 | right)
        if pair is None:
            now[at] = -1
        else:
            now[at] = new = pair >> _RANK
            heappush(heap, new << 32 | at)

    while heap:
        entry = heappop(heap)
        at = entry & 0xFFFFFFFF
        if now[at] != entry >> 32:
            continue
        gone = after[at]
        made = pairs[held[at] << 32 | held[gone]] & 0xFFFFFFFF
        held[at], held[gone], now[gone] = made, -1, -1
        right = after[at] = after[gone]
        if right < n:
            before[right] = at
            renew(at, made, held[right])
        else:
            now[at] = -1
        if (left := before[at]) >= 0:
            renew(left, held[left], made)
    found = np.frombuffer(held, np.int64)
    return found[found >= 0]
