"""Bytes inside strings that occur more than once in the corpus.

Strings are compared by names. A byte is its own name, three neighbouring names give the name of a string three times as long, and
so on up to the wanted length; a name is 64 bits, where a suffix array would number the sorted triples, because only equality
up to a fixed depth is asked for. Sampled names come first: every string of the wanted length (a window) is sampled at its smallest
name of `sample` bytes, so that equal windows have equal samples. Only where a sample occurs more than once are the remaining
suffixes merged: the windows of such places are brought together by their sample, sorted by the names of their whole length,
and neighbours in that order are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.blocks import side_by_side
from admitlens.llm.common import LAST_ID, text_of, two_hashes
from admitlens.sources.stage import release, staged


@dataclass(frozen=True)
class Repeats:
    """Length of the strings, bytes of a sampled name, bytes of a text worked on at once, places of a sample that one task compares (under 7 MB)."""

    length: int = 200
    sample: int = 24
    block: int = 1 << 19
    together: int = 16384


_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_TOP = np.iinfo(np.uint64).max
_PLACE = np.uint64((1 << 20) - 1)  # places within a block; a block is shorter


def _triple(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = (x * _A) ^ (y + (x >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(29))) * _B + z
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(29))


def names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of the string of `length` bytes at every place that has one."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    name, wide = data.astype(np.uint64) + np.uint64(1), 1
    while wide < length:
        end = min(2 * wide, length - wide)  # where the third part starts; parts overlap in the last round
        n = len(name) - end
        name = _triple(name[:n], name[end // 2 : n + end // 2], name[end : n + end])
        wide += end
    return name


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every run of n."""
    rows = -(-len(x) // n)
    table = np.full(rows * n, _TOP)
    table[: len(x)] = x
    table = table.reshape(rows, n)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: len(x) - n + 1], before[n - 1 : len(x)])


def samples(data: np.ndarray, p: Repeats) -> tuple[list[int], list[int], list[int]]:
    """Runs of windows with one sample: (name, first window, last window)."""
    out: tuple[list, list, list] = ([], [], [])
    last = len(data) - p.length
    for at in range(0, last + 1, p.block):
        part = data[at : min(at + p.block + p.length - 1, len(data))]
        name = names(part, p.sample)
        # the first of equal ones: so two places of a run of windows never share a name unseen
        least = _smallest((name & ~_PLACE) | np.arange(len(name), dtype=np.uint64), p.length - p.sample + 1)
        cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        out[0].extend(name[(least[cuts] & _PLACE).astype(np.int64)].astype(np.int64).tolist())
        out[1].extend((cuts + at).tolist())
        out[2].extend((np.append(cuts[1:], len(least)) - 1 + at).tolist())
    return out


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _samples_udf(p: Repeats):
    kind = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (("name", T.LongType()), ("lo", T.IntegerType()), ("hi", T.IntegerType()))])

    @F.pandas_udf(kind)
    def sampled(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([samples(_bytes(t), p) for t in texts], columns=["name", "lo", "hi"])

    return sampled


def _contexts_udf():
    """(text, places) -> the bytes of each place's windows."""

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def contexts(texts: pd.Series, lo: pd.Series, hi: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for text, first, last, n in zip(texts, lo, hi, length):
            data = text.encode("utf-8", "surrogatepass")
            out.append([data[a : b + n] for a, b in zip(first, last)])
        return pd.Series(out)

    return contexts


def _window_names_udf(p: Repeats):
    """bytes of a place -> the names of its windows."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def named(contexts: pd.Series) -> pd.Series:
        return pd.Series([names(np.frombuffer(x, np.uint8), p.length).astype(np.int64) for x in contexts])

    return named


def _compared(p: Repeats):
    """Windows of one sample, sorted by name; neighbours that agree are repeats: (doc, c, a, b), bytes a to b of a text."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole(batches):
            sizes = block["context"].str.len().to_numpy()
            name = names(np.frombuffer(b"".join(block["context"]), np.uint8), p.length)
            ends = np.cumsum(sizes)
            n = sizes - p.length + 1  # windows of each row
            row = np.repeat(np.arange(len(block)), n)
            start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            name = name[(ends - sizes)[row] + start]
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            again = np.zeros(len(row), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            at = np.flatnonzero(again)
            if len(at):
                first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)])
                a = at[first]
                b = at[np.append(np.flatnonzero(first)[1:], len(at)) - 1]
                of = block.iloc[row[a]]
                yield pd.DataFrame({"doc": of["doc"].to_numpy(), "c": of["c"].to_numpy(), "a": of["lo"].to_numpy() + start[a], "b": of["lo"].to_numpy() + start[b] + p.length})

    return compare


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut where a sample ends."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        name = batch["name"].to_numpy()
        cut = np.searchsorted(name, name[-1]) if len(name) else 0
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted spans that neither overlap nor touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut_udf():
    kind = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, starts, ends):
            data, spans = text.encode("utf-8", "surrogatepass"), merged(list(zip(a.tolist(), b.tolist())))
            kept = b"".join(data[x:y] for x, y in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(data)]))
            out.append((sum(s[1] - s[0] for s in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def repeated_bytes(docs: DataFrame, p: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes).

    A byte is removed if a string of `length` bytes that covers it starts at another place too, in any text; strings are judged on
    the input. Equal texts are compared once and, if long enough, removed wholly. A null text is an empty one; a null doc_id
    is an id like others; rows repeated under one id are equal texts. An empty table gives no rows; other columns are not read.
    """
    body = text_of()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc")
    base = docs.select("doc_id", doc, F.xxhash64(body).alias("c"), body.alias("body"))
    size = F.octet_length("body").cast("long").alias("n_bytes")
    rows = staged(base.select("doc_id", "doc", "c", size, F.sha2("body", 256).alias("sha"), _samples_udf(p)("body").alias("s")))
    texts = staged(rows.groupBy("c").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("sha").alias("sha")))

    counts = rows.select(F.explode("s.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = staged(counts.select("name", (F.col("n") > p.together).alias("many")))
    places = rows.select("doc", "c", F.explode(F.arrays_zip("s.name", "s.lo", "s.hi")).alias("x")).select("doc", "c", "x.*")
    places = places.join(often, "name").groupBy("doc", "c").agg(F.collect_set(F.struct("many", "name", "lo", "hi")).alias("places"))
    chosen = places.join(texts.select("doc", "c"), ["doc", "c"])
    # one row per distinct text that holds a repeated sample; a merge join at every size
    held = base.join(chosen.hint("merge"), ["doc", "c"]).select("doc", "c", "body", "places").dropDuplicates(["doc", "c"])
    held = staged(held)

    of = lambda many: held.withColumn("p", F.filter("places", lambda x: x["many"] == many)).filter(F.size("p") > 0)
    few = of(False).select("doc", "c", "p", _contexts_udf()("body", "p.lo", "p.hi", F.lit(p.length)).alias("context"))
    few = few.select("doc", "c", F.explode(F.arrays_zip("p", "context")).alias("x")).select(F.col("x.p.name").alias("name"), "doc", "c", F.col("x.p.lo").alias("lo"), "x.context")
    spans = side_by_side(few, ["name"]).mapInPandas(_compared(p), "doc long, c long, a int, b int")

    # samples with more places than one task compares: equal contexts are one, then all windows of different ones meet by name
    many = of(True).select("doc", "c", "p", _contexts_udf()("body", "p.lo", "p.hi", F.lit(p.length)).alias("context"))
    many = many.select("doc", "c", F.explode(F.arrays_zip("p", "context")).alias("x")).select("doc", "c", F.col("x.p.lo").alias("lo"), "x.context")
    h1, h2 = two_hashes(F.col("context"))
    many = staged(many.select("doc", "c", "lo", "context", h1.alias("h1"), h2.alias("h2")))
    apart = staged(many.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("context")))
    windows = staged(apart.select("h1", "h2", "n", F.posexplode(_window_names_udf(p)("context")).alias("a", "name")))
    again = staged(windows.groupBy("name").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("name"))
    single = windows.filter("n = 1").join(again, "name").select("h1", "h2", "a", (F.col("a") + p.length).alias("b"))
    whole = apart.filter("n > 1").select("h1", "h2", F.lit(0).alias("a"), F.octet_length("context").alias("b"))
    found = many.select("doc", "c", "lo", "h1", "h2").join(staged(single.union(whole)), ["h1", "h2"])
    spans = spans.union(found.select("doc", "c", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")))

    gone = spans.groupBy("doc", "c").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = held.select("doc", "c", "body").join(gone, ["doc", "c"]).select("c", _cut_udf()("body", "spans.a", "spans.b").alias("r"))
    kept = ["r.kept"] if with_text else []
    results = staged(cut.select("c", "r.n_removed", "r.n_spans", "r.kept_sha256", *kept))
    release(many, apart, windows, again, held)

    full = (F.col("copies") > 1) & (F.col("n_bytes") >= p.length)
    judged = texts.join(results, "c", "left").select(
        "c", "n_bytes", F.when(full, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(full, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(full, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(full, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    out = rows.select("doc_id", "c").join(staged(judged), "c").drop("c")
    return out
