"""Packing pieces of documents into sequences of a fixed length by patterns fitted to the histogram of lengths.

Lengths fall into classes (rounded up). All patterns of a few classes that fill a sequence are enumerated, and
their repeat counts are fitted to the histogram of classes by non-negative least squares and rounded down to what is
there. The pieces left over, among them all short ones, go by best fit into the gaps of those sequences and
into new ones. All of this works on counts per length, at most `length` numbers however many pieces there are; the
pieces then take their places by their number among the pieces of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.common import numbered, text_of
from admitlens.llm.tokens import pieces_udf
from admitlens.sources.stage import staged


@dataclass(frozen=True)
class Packing:
    """Parameters: sequence length, number of length classes, documents in a pattern at most, shortest class in a pattern."""

    length: int = 4096
    classes: int = 64
    most: int = 4
    least_class: int = 3


def patterns(p: Packing) -> list[tuple[int, ...]]:
    """Descending classes, at most `most` of them, that add up to a full sequence."""

    def fill(rest: int, top: int, parts: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif parts:
            for k in range(min(rest, top), p.least_class - 1, -1):
                for tail in fill(rest - k, k, parts - 1):
                    yield (k, *tail)

    return list(fill(p.classes, p.classes, p.most))


def non_negative_fit(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: grow the set of positive entries, step back where one would turn negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = np.abs(a.T @ b).max(initial=0)
    for _ in range(6 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance * scale:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            drop = x[at][low] - s[low]
            step = np.min(np.where(drop > 0, x[at][low] / np.where(drop > 0, drop, 1), 0))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            active[gone if len(gone) else at[low][:1]] = False
            x[~active] = 0
    return x


class Plan:
    """Places by length: pieces [first, first + n) of a length go to sequences from `sequence` on, at `offset`."""

    def __init__(self, counts: np.ndarray, p: Packing) -> None:
        self.p, self.left, self.given = p, counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first, n, sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, number)
        self.gaps: list[int] = []
        self.sequences = 0
        self._patterns()
        self._rest()

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.given[length]), n, sequence, offset))
        self.given[length] += n
        self.left[length] -= n

    def _offer(self, gap: int, sequence: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not self.open[gap]:
                insort(self.gaps, gap)
            self.open[gap].append((sequence, n))

    def _patterns(self) -> None:
        p, width = self.p, -(-self.p.length // self.p.classes)
        kinds = patterns(p)
        klass = -(-np.arange(len(self.left)) // width)
        per_class = np.bincount(klass, self.left, p.classes + 1).astype(np.int64)
        a = np.zeros((p.classes + 1, len(kinds)))
        for j, kind in enumerate(kinds):
            for k in kind:
                a[k, j] += 1
        used = per_class.astype(float)
        used[: p.least_class] = 0
        fit = np.floor(non_negative_fit(a, used) + 1e-6).astype(np.int64)
        lengths = [[x for x in range(k * width, (k - 1) * width, -1) if x < len(self.left)] for k in range(p.classes + 1)]
        for j in np.argsort(-fit, kind="stable"):
            kind = kinds[j]
            need = {k: kind.count(k) for k in kind}
            repeats = int(min([fit[j], *(per_class[k] // c for k, c in need.items())]))
            if repeats <= 0:
                continue
            for k, c in need.items():
                per_class[k] -= repeats * c
            self._repeat(kind, repeats, lengths)

    def _repeat(self, kind: tuple[int, ...], repeats: int, lengths: list[list[int]]) -> None:
        """Fill `repeats` new sequences slot by slot, the longest pieces of each class first, then note their gaps."""
        fill = [(self.sequences, repeats, 0)]
        self.sequences += repeats
        for k in kind:
            after = []
            # the fullest sequences get the shorter pieces of the class
            todo = sorted(fill, key=lambda x: x[2])
            for length in lengths[k]:
                while self.left[length] and todo:
                    sequence, n, used = todo[0]
                    take = int(min(n, self.left[length]))
                    self._put(length, take, sequence, used)
                    after.append((sequence, take, used + length))
                    todo[0] = (sequence + take, n - take, used)
                    if n == take:
                        todo.pop(0)
                if not todo:
                    break
            fill = after
        for sequence, n, used in fill:
            self._offer(self.p.length - used, sequence, n)

    def _rest(self) -> None:
        """Best fit, from the longest piece to the shortest."""
        for length in range(len(self.left) - 1, 0, -1):
            while self.left[length]:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    self._new(length)
                    continue
                gap = self.gaps[at]
                sequence, n = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
                take = int(min(n, self.left[length]))
                self._put(length, take, sequence, self.p.length - gap)
                self._offer(gap - length, sequence, take)
                self._offer(gap, sequence + take, n - take)

    def _new(self, length: int) -> None:
        each = self.p.length // length
        n = int(max(1, self.left[length] // each))
        for k in range(min(each, int(self.left[length]) // n)):
            self._put(length, n, self.sequences, k * length)
        self._offer(self.p.length - (k + 1) * length, self.sequences, n)
        self.sequences += n

    def table(self) -> tuple[np.ndarray, ...]:
        """Sorted by (length, first): columns length, first, sequence, offset."""
        runs = np.array(self.runs, np.int64).reshape(-1, 5)
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        return runs[:, 0], runs[:, 1], runs[:, 3], runs[:, 4]


def _place_udf(plan: Plan):
    lengths, firsts, sequences, offsets = plan.table()
    starts = np.searchsorted(lengths, np.arange(plan.p.length + 2))
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(kind)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        run = np.empty(len(length), np.int64)
        for x in np.unique(length):
            at = length == x
            run[at] = starts[x] + np.searchsorted(firsts[starts[x] : starts[x + 1]], rank[at], "right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + rank - firsts[run], "offset": offsets[run]})

    return place


def pieces(docs: DataFrame, tokenizer: str, p: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids: little-endian 32-bit bytes) of every row of `docs`.

    A null or empty text is the closing id alone. Only texts longer than a sequence are cut.
    """
    cut = docs.select("doc_id", pieces_udf(tokenizer, p.length, with_ids)(text_of()).alias("p"))
    columns = ["start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    zipped = F.posexplode(F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in columns])).alias("piece", "x")
    return cut.select("doc_id", zipped).select("doc_id", "piece", *[F.col(f"x.{c}").alias(c) for c in columns])


def packed(docs: DataFrame, tokenizer: str, p: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset.

    Repeated rows are packed as often as they stand in `docs`, an empty table gives none; columns other than
    doc_id and text are not read. Sequences have no gaps before their end.
    """
    rows = staged(pieces(docs, tokenizer, p, with_ids))
    counts = np.zeros(p.length + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most p.length rows
        counts[length] = n
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = numbered(rows, ["length"], order, int(counts.sum()), "rank")
    placed = ranked.withColumn("at", _place_udf(Plan(counts, p))("length", "rank"))
    return placed.select(*rows.columns, "at.*")


def sequences(docs: DataFrame, tokenizer: str, p: Packing = Packing()) -> DataFrame:
    """sequence_id, ids (at most `length` token ids as bytes) and the documents in it, in order."""
    parts = packed(docs, tokenizer, p, with_ids=True).select("sequence_id", F.struct("offset", "doc_id", "piece", "ids").alias("part"))
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    ids = F.aggregate("parts.ids", F.lit(b""), lambda acc, x: F.concat(acc, x))
    return ordered.select("sequence_id", ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
