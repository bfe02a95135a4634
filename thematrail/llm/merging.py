"""Pair merging for many words at once, and what the two tokenizers share around it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from heapq import heapify, heappop, heappush

import numpy as np

#: Symbols of a word up to which words are merged together, and the widths in which they are laid out.
LONGEST, WIDTHS = 64, (4, 8, 12, 16, 24, 32, 48, 64)

NO_RANK = np.iinfo(np.int32).max


class PairTable:
    """Which pairs of symbols merge: rank (the lowest goes first, equal ranks from the left) and resulting symbol.

    An open-addressed hash table in numpy arrays, filled once, of at most half its slots.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(left) + 1))) + 1)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, np.int32)
        self.result = np.full(1 << self.bits, -1, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] == -1]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[first]], self.rank[slot[first]], self.result[slot[first]] = keys[first], rank[first], result[first]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
        self.empty = int(np.flatnonzero(self.key == -1)[0])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; slots of pairs that do not merge have no rank."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        slot = self._slot(keys)
        missed = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] != -1))
        while len(missed):
            slot[missed] = (slot[missed] + 1) & (len(self.key) - 1)
            at = self.key[slot[missed]]
            missed = missed[(at != keys[missed]) & (at != -1)]
        slot[self.key[slot] != keys] = self.empty
        return slot.reshape(left.shape)


def merge_words(table: PairTable, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of ``sizes`` symbols, given one after the other: the tokens in the same form.

    In each word the pair of lowest rank, the leftmost of equals, is merged until none is left. Words are laid out
    as rows of a matrix; every round merges one pair in every row, so that the matrix loses a column.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found_sizes = np.zeros(len(sizes), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    below = 0
    for width in (*WIDTHS, max(int(sizes.max(initial=0)), LONGEST)):
        rows = np.flatnonzero((sizes > below) & (sizes <= width))
        below = width
        if not len(rows):
            continue
        width = int(sizes[rows].max())
        columns = np.arange(width)
        real = columns < sizes[rows][:, None]
        ids = np.where(real, symbols[np.minimum(starts[rows][:, None] + columns, len(symbols) - 1)], -1).astype(np.int32)
        ranks = np.where(real[:, 1:], table.rank[table.find(ids[:, :-1], ids[:, 1:].clip(0))], NO_RANK)
        while True:
            if ids.shape[1] > 1:
                best = ranks.argmin(axis=1)
                going = ranks[np.arange(len(rows)), best] != NO_RANK
            else:
                going = np.zeros(len(rows), bool)
            if not going.all():
                done = ids[~going]
                found_sizes[rows[~going]] = (done >= 0).sum(axis=1)
                found.append((rows[~going], done))
                if not going.any():
                    break
                rows, ids, ranks, best = rows[going], ids[going], ranks[going], best[going]
            line = np.arange(len(rows))
            ids[line, best] = table.result[table.find(ids[line, best], ids[line, best + 1])]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
            for at in (best - 1, best):
                some = np.flatnonzero((at >= 0) & (at < ids.shape[1] - 1))
                left, right = ids[some, at[some]], ids[some, at[some] + 1]
                ranks[some, at[some]] = np.where(right >= 0, table.rank[table.find(left, right.clip(0))], NO_RANK)
    tokens = np.empty(found_sizes.sum(), np.int32)
    places = np.concatenate([[0], np.cumsum(found_sizes)])
    for rows, ids in found:
        real = ids >= 0
        tokens[(places[rows][:, None] + np.arange(ids.shape[1]))[real]] = ids[real]
    return tokens, found_sizes


def merge_long(ids: list[int], pairs: Mapping[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge one word of any length, by a heap of its pairs: ``pairs`` gives rank and resulting symbol."""
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    heap = [(found[0], i) for i in range(len(ids) - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
    heapify(heap)
    while heap:
        rank, at = heappop(heap)
        nxt = after[at]
        if ids[at] < 0 or nxt < 0 or not (found := pairs.get((ids[at], ids[nxt]))) or found[0] != rank:
            continue  # one of the two has been merged meanwhile
        ids[at], ids[nxt] = found[1], -1
        after[at] = after[nxt]
        if after[at] >= 0:
            before[after[at]] = at
        for left in (before[at], at):
            if left >= 0 and after[left] >= 0 and (found := pairs.get((ids[left], ids[after[left]]))):
                heappush(heap, (found[0], left))
    return [i for i in ids if i >= 0]


class Remembered:
    """A bounded cache that is filled for many keys at once and keeps what was used since the last two fillings."""

    def __init__(self, make: Callable[[list], Iterable], size: int):
        self.make, self.size = make, size
        self.now: dict = {}
        self.older: dict = {}

    def get(self, keys: Sequence) -> Callable:
        """Look-up that knows all of ``keys``, until the next call."""
        wanted = set(keys).difference(self.now)
        if wanted:
            if len(self.now) + len(wanted) > self.size and self.now:
                self.older, self.now = self.now, {}
                wanted = set(keys)
            unseen = []
            for key in wanted:
                value = self.older.get(key)
                if value is None:
                    unseen.append(key)
                else:
                    self.now[key] = value
            self.now.update(zip(unseen, self.make(unseen)))
        return self.now.__getitem__


def slices(octets: bytes, size: int) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes that end after an ASCII space (or, without any, at the end)."""
    start = 0
    while len(octets) - start > size:
        cut = octets.rfind(b" ", start, start + size) + 1 or octets.find(b" ", start + size) + 1
        if not cut:
            break
        yield octets[start:cut]
        start = cut
    yield octets[start:] if start else octets


def loads(values: Iterable[bytes], size: int) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Texts dealt out in loads of about ``size`` bytes: (row, slice, whether it is the last of its row)."""
    load: list[tuple[int, bytes, bool]] = []
    held = 0
    for row, value in enumerate(values):
        left = len(value)
        for part in slices(value, size):
            left -= len(part)
            load.append((row, part, not left))
            held += len(part)
            if held >= size:
                yield load
                load, held = [], 0
    if load:
        yield load
