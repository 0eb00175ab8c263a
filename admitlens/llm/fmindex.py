"""FM-index of a text of numbered words: suffix array, wavelet ranks of the transform, sampled positions (numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 32  # every so many places of the text, the row of its suffix knows the place


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text that ends with 0, where every 0 is a letter of its own, smaller than all others.

    Prefix doubling: the first key holds as many letters as fit into 62 bits, later rounds sort only what is still tied.
    """
    n = len(text)
    ends = text == 0
    key = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    bits = max(1, int(key.max()).bit_length())
    known = max(1, 62 // bits)
    packed = key.copy()
    for k in range(1, known):
        packed <<= bits
        if k < n:
            packed[: n - k] |= key[k:]
    order = np.argsort(packed)
    packed = packed[order]
    first = np.append(True, packed[1:] != packed[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    alone = first & np.append(first[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        pair = (rank[at] << 32) | rank[at + known]  # what is tied holds no end, so it doesn't reach beyond the text
        by = np.argsort(pair)
        pair, at = pair[by], at[by]
        first = np.append(True, pair[1:] != pair[:-1])
        order[slots] = at
        rank[at] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        slots = slots[~(first & np.append(first[1:], True))]
        known *= 2
    return order


def packed_bits(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits) // 64 + 1, np.uint64)
    raw = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(raw)] = raw
    return out


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        ones = np.bitwise_count(words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


@dataclass(frozen=True)
class Built:
    """What is stored of an index: counts of the letters, the bits of each wavelet level, marks of sampled rows and their places."""

    counts: np.ndarray
    levels: list[np.ndarray]
    marks: np.ndarray
    places: np.ndarray


def build(text: np.ndarray, letters: int) -> Built:
    """Index of a text of letters 0 to `letters`, which ends with 0; 0 ends a document."""
    order = suffix_array(text)
    last = text[order - 1]  # of the suffix at 0: the end of the text
    counts = np.bincount(text, minlength=letters + 1)
    levels, now = [], last.astype(np.uint32)
    for level in reversed(range(max(1, int(letters).bit_length()))):
        ones = (now >> np.uint32(level)) & np.uint32(1) != 0
        levels.append(packed_bits(ones))
        now = np.concatenate([now[~ones], now[ones]])
    marked = (order % SAMPLE == 0) | (last == 0)  # a way back meets a mark before it would leave its document
    return Built(counts.astype(np.int32), levels, packed_bits(marked), order[marked].astype(np.int32))


class FmIndex:
    """Backward search and location. The wavelet levels lie one after the other, zeros of a level before its ones."""

    def __init__(self, b: Built) -> None:
        counts = b.counts.astype(np.int64)
        self.size = int(counts.sum())
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels = [Bits(w) for w in b.levels]
        self.zeros = [self.size - int(np.bitwise_count(w).sum()) for w in b.levels]
        self.marks, self.places = Bits(b.marks), b.places
        # where a letter's occurrences begin below the last level: in the order of its bits from the lowest
        letter = np.arange(len(counts))
        turned = np.zeros(len(counts), np.int64)
        for k in range(len(self.levels)):
            turned = (turned << 1) | ((letter >> k) & 1)
        by = np.argsort(turned)
        begin = np.empty(len(counts), np.int64)
        begin[by] = np.cumsum(counts[by]) - counts[by]
        self.shift = self.first[:-1] - begin

    def step(self, letter: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row of the suffix that puts `letter` before those counted by i: its first row and the letter's rank at i."""
        at = i
        top = len(self.levels) - 1
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(at)
            at = np.where((letter >> (top - k)) & 1, zeros + ones, at - ones)
        return at + self.shift[letter]

    def back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one place earlier."""
        letter, at = np.zeros(len(row), np.int64), row
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(at), bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
            letter = (letter << 1) | one
        return at + self.shift[letter]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and the row behind the last of the suffixes that begin with each pattern.

        A pattern is a row of letters, the last one in the last column, with -1 before its first; it holds one letter at least,
        and 0 stands for a letter that the text doesn't have.
        """
        lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.flatnonzero(~(patterns == 0).any(axis=1))
        letter = patterns[live, -1]
        lo[live], hi[live] = self.first[letter], self.first[letter + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = live[(patterns[live, k] > 0) & (hi[live] > lo[live])]
            if not len(live):
                break
            letter = patterns[live, k].astype(np.int64)
            lo[live], hi[live] = self.step(letter, lo[live]), self.step(letter, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes of these rows."""
        out = np.empty(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows, 0
        while len(left):
            marked = self.marks.get(row)
            out[left[marked]] = self.places[self.marks.ones(row[marked])] + steps
            left, row = left[~marked], row[~marked]
            row, steps = self.back(row), steps + 1
        return out
