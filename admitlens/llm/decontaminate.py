"""Benchmark passages in training documents, found with an FM-index per training shard.

The rows of a partition fill shards of bounded size; a shard numbers its own words, and the index over these numbers is written
once, whatever the benchmark. The benchmark's windows of words then come in blocks of bounded size, each of which is searched
backwards in every shard, located, and laid over the documents. Texts never leave the partition they are read in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.common import text_of, two_hashes
from admitlens.llm.fmindex import Built, FmIndex, build
from admitlens.llm.suffixes import merged
from admitlens.sources.stage import staged


@dataclass(frozen=True)
class Windows:
    """Words of a window, words and bytes of a shard, bytes of a document worked on at once, windows in a block, rows located at once."""

    width: int = 10
    shard_words: int = 1 << 20
    shard_bytes: int = 1 << 24
    piece_bytes: int = 1 << 22
    block: int = 1 << 17
    at_once: int = 1 << 18


# What a word is made of, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_BYTES = T.BinaryType()
_INDEX = T.StructType([
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("row", "doc_id", "h1", "h2", "before", "n_words", "start")],
    T.StructField("words", _BYTES), T.StructField("counts", _BYTES), T.StructField("levels", T.ArrayType(_BYTES)), T.StructField("marks", _BYTES), T.StructField("places", _BYTES),
])
_HITS = "row long, doc_id long, h1 long, h2 long, n_words long, items array<string>, spans array<struct<a:long,b:long>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def pieces(text: bytes, p: Windows) -> Iterator[tuple[int, list[bytes], int]]:
    """(words before, words, how many of them the piece before has too) of a text, in pieces that share width - 1 words."""
    plain = text.translate(_PLAIN)
    at, before, tail = 0, 0, []
    while True:
        end = plain.find(b" ", at + p.piece_bytes) if at + p.piece_bytes < len(plain) else -1
        words = tail + plain[at : end if end >= 0 else len(plain)].split()
        yield before, words, len(tail)
        if end < 0:
            return
        keep = max(0, len(words) - p.width + 1)
        before, tail, at = before + keep, words[keep:], end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class _Shard:
    """Documents of a shard on their way into an index."""

    def __init__(self) -> None:
        self.numbers, self.text, self.rows, self.size, self.bytes = _Numbers(), [], [], 0, 0

    def add(self, row: tuple, before: int, words: list[bytes], shared: int) -> None:
        self.rows.append((*row, before, len(words) - shared, self.size))
        self.text.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.text.append(np.zeros(1, np.int32))
        self.size += len(words) + 1
        self.bytes += sum(map(len, words)) + 64

    def record(self) -> pa.RecordBatch:
        b = build(np.concatenate(self.text), len(self.numbers))
        longs = [pa.array([list(c)], pa.list_(pa.int64())) for c in zip(*self.rows)]
        rest = [b"\n".join(self.numbers), b.counts.tobytes(), [x.tobytes() for x in b.levels], b.marks.tobytes(), b.places.tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([*longs, *[pa.array([x], k) for x, k in zip(rest, kinds)]], names=_INDEX.names)


def _indexed(p: Windows):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, shard = TaskContext.get().partitionId() << 40, _Shard()
        for batch in batches:
            texts = batch.column("body").cast(pa.binary())
            for k, head in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "h1", "h2")])):
                for before, words, shared in pieces(texts[k].as_py(), p):
                    if shard.rows and (shard.size + len(words) >= p.shard_words or shard.bytes >= p.shard_bytes):
                        yield shard.record()
                        shard = _Shard()
                    shard.add((row, *head), before, words, shared)
                row += 1
        if shard.rows:
            yield shard.record()

    return write


def shard_indexes(docs: DataFrame, p: Windows = Windows()) -> DataFrame:
    """A row per training shard, staged: its documents, words, and FM-index. Its texts can be searched for any benchmark."""
    body = text_of()
    h1, h2 = two_hashes(body)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), body.alias("body"))
    return staged(rows.mapInArrow(_indexed(p), _INDEX))


@dataclass(frozen=True)
class Block:
    """Windows as rows of word numbers, right-aligned, and the items of each."""

    vocabulary: list[bytes]
    windows: np.ndarray
    items: np.ndarray
    item_starts: np.ndarray

    @staticmethod
    def of(pairs: list[tuple[str, str]], width: int) -> Block:
        by: dict[str, list[str]] = {}
        for window, item in pairs:
            by.setdefault(window, []).append(item)
        numbers = _Numbers()
        windows = np.full((len(by), width), -1, np.int64)
        for k, window in enumerate(by):
            words = window.encode("utf-8", "surrogatepass").split(b" ")
            windows[k, width - len(words) :] = [numbers[w] - 1 for w in words]
        starts = np.cumsum([0, *map(len, by.values())])
        return Block(list(numbers), windows, np.array([i for v in by.values() for i in v], object), starts)


def blocks_of(benchmark: DataFrame, p: Windows = Windows()) -> list[Block]:
    """The windows of the items, in blocks of bounded size that reach the driver one by one."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - p.width + 1, F.lit(1)))
    windows = words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(p.width)), " "))).alias("window")).distinct()
    n = max(1, -(-windows.count() // p.block))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(n)))
    dealt = dealt if n == 1 else staged(dealt)
    return [Block.of([(r.window, r.item) for r in dealt.filter(F.col("block") == k).collect()], p.width) for k in range(n)]


def _lists(of: np.ndarray, n: int) -> pa.Array:
    """Offsets of n lists whose members, sorted by list, belong to `of`."""
    return pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())


def _found(index: FmIndex, words: list[bytes], block: Block, p: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence in a shard, in portions."""
    number = dict(zip(words, range(1, len(words) + 1)))
    own = np.array([*[number.get(w, 0) for w in block.vocabulary], -1])
    lo, hi = index.search(own[block.windows])
    which = np.repeat(np.arange(len(lo)), hi - lo)
    begin = np.cumsum(hi - lo) - (hi - lo)
    row = np.arange(len(which)) - np.repeat(begin - lo, hi - lo)
    place = [index.locate(row[at : at + p.at_once]) for at in range(0, len(row), p.at_once)]
    return np.concatenate([*place, np.empty(0, np.int64)]), which


def _searched(block, first: bool, p: Windows):
    """Rows of an index -> the documents hit by a broadcast block, and with `first` the others too."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        length = (b.windows >= 0).sum(axis=1)
        for batch in batches:
            for k in range(len(batch)):
                r = {c: batch.column(c)[k] for c in _INDEX.names}
                raw = lambda c, kind: np.frombuffer(r[c].as_buffer(), kind)
                levels = [np.frombuffer(x.as_buffer(), np.uint64) for x in r["levels"]]
                index = FmIndex(Built(raw("counts", np.int32), levels, raw("marks", np.uint64), raw("places", np.int32)))
                start, before = (r[c].values.to_numpy() for c in ("start", "before"))
                place, window = _found(index, r["words"].as_py().split(b"\n"), b, p)
                n, size = len(start), index.size
                cover = np.cumsum(np.bincount(place, minlength=size + 1) - np.bincount(place + length[window], minlength=size + 1)) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], cover]).astype(np.int8)))
                a, z = edges[::2], edges[1::2]
                doc = np.searchsorted(start, a, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(x - start[doc] + before[doc]) for x in (a, z)], ["a", "b"])
                hit = np.unique((np.searchsorted(start, place, "right") - 1) * len(b.windows) + window)
                at, w = hit // max(1, len(b.windows)), hit % max(1, len(b.windows))
                n_items = b.item_starts[w + 1] - b.item_starts[w]
                item = np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items - b.item_starts[w], n_items)
                items = pa.ListArray.from_arrays(_lists(np.repeat(at, n_items), n), pa.array(b.items[item], pa.string()))
                columns = [r[c].values for c in ("row", "doc_id", "h1", "h2")]
                columns.append(r["n_words"].values if first else pa.array(np.zeros(n, np.int64)))
                out = pa.RecordBatch.from_arrays([*columns, items, pa.ListArray.from_arrays(_lists(doc, n), spans)], names=["row", "doc_id", "h1", "h2", "n_words", "items", "spans"])
                yield out if first else out.filter(pa.array(np.isin(np.arange(n), doc)))

    return search


def _merged_udf():
    kind = T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    @F.pandas_udf(kind)
    def whole(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        spans = [merged(list(zip(a.tolist(), b.tolist()))) for a, b in zip(starts, ends)]
        return pd.DataFrame({"n_hit": [sum(b - a for a, b in s) for s in spans], "spans": spans})

    return whole


def contamination(docs: DataFrame, benchmark: DataFrame, p: Windows = Windows()) -> DataFrame:
    """One row per row of `docs`: doc_id, h1 and h2 (hashes of the text), n_words, n_hit, items (sorted ids as text), spans.

    A span [a, b] holds the words a to b - 1 (from 0) and is as long as can be; every word in it lies in an occurrence of `width`
    consecutive words of an item, or of all words of an item that has fewer. A null text has no words, a null item id is the
    empty text, rows of one item id are one item; repeated rows and ids are judged each for itself. Long documents are indexed in
    pieces that share width - 1 words. An empty benchmark hits nothing, no documents give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    indexes = shard_indexes(docs, p)
    hits = None
    for k, block in enumerate(blocks_of(benchmark, p)):
        part = indexes.mapInArrow(_searched(spark.sparkContext.broadcast(block), k == 0, p), _HITS)
        hits = part if hits is None else hits.union(part)
    once = hits.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.sum("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("s"),
    )
    out = once.withColumn("m", _merged_udf()("s.a", "s.b"))
    return out.select("doc_id", "h1", "h2", "n_words", "m.n_hit", "items", "m.spans")


def _without_udf():
    @F.pandas_udf(T.StringType())
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            raw = text.encode("utf-8", "surrogatepass")
            plain = np.frombuffer(raw.translate(_PLAIN), np.uint8) != 32
            edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
            at = [0, *[x for a, b in cuts for x in (int(edges[2 * a]), int(edges[2 * b - 1]))], len(raw)]
            out.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    return without


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: Windows = Windows()) -> DataFrame:
    """`docs` without the words of the spans, from the first letter of a span to its last; other rows and columns stay as they are."""
    found = contamination(docs, benchmark, p).filter("n_hit > 0")
    cuts = staged(found.groupBy("h1", "h2").agg(F.first("spans").alias("_cut_spans")).withColumnsRenamed({"h1": "_cut_h1", "h2": "_cut_h2"}))
    h1, h2 = two_hashes(text_of())
    joined = docs.withColumns({"_cut_h1": h1, "_cut_h2": h2}).join(cuts, ["_cut_h1", "_cut_h2"], "left")
    hit = joined.filter(F.col("_cut_spans").isNotNull()).withColumn("text", _without_udf()(text_of(), "_cut_spans"))
    return joined.filter(F.col("_cut_spans").isNull()).unionByName(hit).select(*docs.columns)
