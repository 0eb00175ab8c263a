"""The prefix trie of all conversations, from double-array tries per shard.

Turns are named by hashes of role and text, equal conversations are one sequence with a count. Sequences are dealt by ranges of their
order, so a shard holds whole branches; only nodes on the paths of its first and last sequence can be in other shards too. Each
shard numbers its turns densely, packs BASE and CHECK arrays and walks them; what shards know of shared upper nodes is merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.common import two_hashes
from admitlens.llm.doublearray import DoubleArray, pack
from admitlens.sources.stage import release, staged


@dataclass(frozen=True)
class Tries:
    """Conversations that share a head come in runs of `family` ids; a conversation takes up to `most_shared` turns of the first one's;
    turns that a shard packs; ids (as a power of 2) that are joined to one text before they are hashed."""

    family: int = 20
    most_shared: int = 3
    shard_turns: int = 1 << 18
    id_bits: int = 12


# Fixed value: what a word is made of.
_WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
_LISTS = ["h1", "h2", "words"]


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, t): the turns of every conversation in their order, each as (h1, h2, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    h1, h2 = two_hashes(F.struct(role.alias("role"), text.alias("text")))
    words = F.regexp_count(text, F.lit(_WORD)).cast("long")
    named = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), h1.alias("h1"), h2.alias("h2"), words.alias("words")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"), lambda a, b: _before(a, b))
    return named.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["h1"], x["h2"], x["words"])).alias("t"))


def _before(a: Column, b: Column) -> Column:
    """Order of turns: null first, then by number, then by their hashes."""
    out = F.lit(0)
    for c in ("h2", "h1", "turn"):
        none = F.when(a[c].isNull() & b[c].isNotNull(), -1).when(a[c].isNotNull() & b[c].isNull(), 1)
        out = none.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def rebuilt(convs: DataFrame, p: Tries = Tries()) -> DataFrame:
    """(conv_id, t): each conversation with its first turns taken from the first conversation of its family. `convs` is read twice."""
    kin = (F.col("conv_id") - F.col("conv_id") % p.family).alias("kin")
    h = (F.crc32(F.col("conv_id").cast("string")) % (p.most_shared + 1)).cast("int").alias("h")
    heads = convs.filter(F.col("conv_id") % p.family == 0).select(F.col("conv_id").alias("kin"), F.slice("t", 1, p.most_shared).alias("head"))
    rows = convs.select("conv_id", "t", kin, h).join(heads, "kin", "left")
    shared = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("t", 1, 0))
    return rows.select("conv_id", F.concat(shared, F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))).alias("t"))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of ids -> one row per sequence with the hash of all its ids, read as a stream."""
    now, turns, state = None, None, None

    def row() -> pa.RecordBatch:
        n, least, sha = state
        return pa.RecordBatch.from_arrays([*turns, pa.array([n]), pa.array([least]), pa.array([sha.hexdigest()])], names=[*_LISTS, "n", "least", "sha"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "ids", "n", "least")]
        for k, (k1, k2, ids, n, least) in enumerate(zip(*columns)):
            if (k1, k2) != now:
                if now is not None:
                    yield row()
                now, turns, state = (k1, k2), [batch.column(c).slice(k, 1) for c in _LISTS], [0, least, hashlib.sha256()]
            else:
                state[2].update(b",")
            state[0] += n
            state[1] = min(state[1], least)
            state[2].update(ids.encode())
    if now is not None:
        yield row()


def sequences(convs: DataFrame, p: Tries = Tries()) -> DataFrame:
    """(h1, h2, words, n, least, sha): the distinct sequences of turns, how many conversations have them, the smallest id, and the hash of all ids."""
    k1, k2 = two_hashes(F.col("t"))
    some = F.shiftright("conv_id", p.id_bits).alias("some")
    parts = convs.select("conv_id", some, k1.alias("k1"), k2.alias("k2"), "t").groupBy("k1", "k2", "some").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("t").alias("t"))
    text = F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")
    rows = parts.select("k1", "k2", "some", text, F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"), *[F.col("t")[c].alias(c) for c in _LISTS])
    return rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "some").mapInArrow(_ended, "h1 array<long>, h2 array<long>, words array<long>, n long, least long, sha string")


class _Branches:
    """Sequences of a shard with dense turn ids, in the order of the hashes."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = {c: table.column(c).combine_chunks() for c in _LISTS}
        self.sizes = np.diff(lists["h1"].offsets.to_numpy())
        self.starts = np.cumsum(self.sizes) - self.sizes
        names = np.empty(int(self.sizes.sum()), [("h1", np.int64), ("h2", np.int64)])
        for c in ("h1", "h2"):
            names[c] = lists[c].flatten().to_numpy()
        self.words = lists["words"].flatten().to_numpy()
        self.names, ids = np.unique(names, return_inverse=True)
        self.ids = ids.astype(np.int64) + 1
        self.n, self.least = (table.column(c).to_numpy() for c in ("n", "least"))
        self.sha = table.column("sha").to_pylist()

    def end(self, last: bool) -> int:
        """The first or last sequence in order; one that ends comes before those that go on."""
        live, depth = np.arange(len(self.sizes)), 0
        while True:
            on = self.sizes[live] > depth
            if (not on.any()) if last else (not on.all()):
                return int(live[~on][0])
            live = live[on]
            ids = self.ids[self.starts[live] + depth]
            live, depth = live[ids == (ids.max() if last else ids.min())], depth + 1


_NODE = "shard int, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, sha string"
_OUT = f"edge boolean, chain int, key binary, words long, {_NODE}"


def _nodes(b: _Branches, trie: DoubleArray, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard; those on the path of its first (chain 0) or last sequence (chain 1) as edges with what only this shard knows.

    Interior nodes hold the sums of their subtrees, edges those of the interior branches that leave them.
    """
    size = len(trie.check)
    n, least, depth, words = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    sha = np.full(size, None, object)
    n[0], least[0] = b.n.sum(), b.least.min()
    for k in np.flatnonzero(b.sizes == 0):
        sha[0] = b.sha[k]
    ends = [b.end(False), b.end(True)]
    paths: list[list[int]] = [[0], [0]]
    levels = []
    for d, live, at in trie.walk(b.ids, b.starts, b.sizes):
        np.add.at(n, at, b.n[live])
        np.minimum.at(least, at, b.least[live])
        depth[at], words[at] = d, b.words[b.starts[live] + d - 1]
        levels.append(np.unique(at))
        for k, place in zip(live[b.sizes[live] == d], at[b.sizes[live] == d]):
            sha[place] = b.sha[k]
        for path, end in zip(paths, ends):
            path.extend(at[live == end].tolist())
    edge = np.zeros(size, bool)
    edge[paths[0]] = edge[paths[1]] = True
    parent = np.maximum(trie.check, 0)
    children = np.bincount(parent[(trie.check >= 0) & ~edge], minlength=size)
    leaves = (~edge & (children == 0)).astype(np.int64)
    saved = np.where(edge, 0, (n - 1) * words)
    for level in reversed(levels):
        inner = level[~edge[level]]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    keys: dict[int, bytes] = {0: b""}
    for path, end in zip(paths, ends):
        for k, place in enumerate(path[1:]):
            keys[place] = hashlib.blake2b(keys[path[k]] + b.names[b.ids[b.starts[end] + k] - 1].tobytes(), digest_size=16).digest()

    def batch(at: np.ndarray, edges: bool, chain: int | None = None, empty: np.ndarray | None = None) -> pa.RecordBatch:
        own = lambda x: pa.array(x[at] if empty is None else np.where(empty, 0, x[at]))
        top = at == 0
        above = parent[at]
        known = ~edge[above] & ~top
        columns = {
            "edge": pa.array(np.full(len(at), edges)), "chain": pa.array([chain] * len(at), pa.int32()), "key": pa.array([keys[x] if edges else None for x in at.tolist()], pa.binary()),
            "words": pa.array(words[at]), "shard": pa.array(np.full(len(at), shard, np.int32)),
            "parent": pa.array([keys[x] if e and not t else None for x, e, t in zip(above.tolist(), edge[above].tolist(), top.tolist())], pa.binary()),
            "conv_id": pa.array(least[at]), "depth": pa.array(depth[at]), "parent_conv_id": pa.array(least[above], mask=~known),
            "n_convs": own(n), "n_children": own(children), "n_leaves": own(leaves), "saved": own(saved), "sha": pa.array(sha[at].tolist(), pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)

    inner = np.flatnonzero((trie.check >= 0) & ~edge)
    for at in range(0, len(inner), 1 << 14):
        yield batch(inner[at : at + (1 << 14)], False)
    seen = np.zeros(size, bool)
    for chain, path in enumerate(paths):
        yield batch(np.array(path), True, chain, seen[path])
        seen[path] = True


def _sharded(arrays: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if len(x)]
        if not held:
            return
        b = _Branches(held)
        trie = pack(b.ids, b.starts, b.sizes)
        shard = TaskContext.get().partitionId()
        if arrays:
            values = [trie.base, trie.check, b.names["h1"], b.names["h2"]]
            lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *lists], names=["shard", "base", "check", "h1", "h2"])
        else:
            yield from _nodes(b, trie, shard)

    return write


def _ranges(found: DataFrame, p: Tries) -> DataFrame:
    """Staged sequences, dealt to shards by ranges of their order."""
    n = found.agg(F.coalesce(F.sum(F.size("h1") + 1), F.lit(0))).first()[0]
    return found.repartitionByRange(max(1, -(-n // p.shard_turns)), F.arrays_zip("h1", "h2"))


def _prepared(turns: DataFrame, p: Tries) -> DataFrame:
    convs = staged(conversations_of(turns))
    found = staged(sequences(rebuilt(convs, p), p))
    release(convs)
    return found


def conversation_tries(turns: DataFrame, p: Tries = Tries()) -> DataFrame:
    """A row per shard: shard, base, check, and the turns (h1, h2) whose dense ids are their positions from 1."""
    return _ranges(_prepared(turns, p), p).mapInArrow(_sharded(True), "shard int, base array<long>, check array<long>, h1 array<long>, h2 array<long>")


def prefix_nodes(turns: DataFrame, p: Tries = Tries()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Rows without conv_id belong to no conversation and are left out; a null role or text is empty; null turn numbers come first and
    turns of equal number follow in an order that their role and text alone decide; repeated rows are turns of their own. A
    conversation is one row of the shuffle (24 bytes a turn), a shard about `shard_turns` turns, however many conversations
    share a turn or are equal. An empty table has no members and gives no rows; other columns are not read.
    """
    nodes = staged(_ranges(_prepared(turns, p), p).mapInArrow(_sharded(False), _OUT))
    edges = nodes.filter("edge")
    owner = F.min(F.struct("shard", "chain")).alias("owner")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    whole = edges.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.max("sha").alias("sha"), owner, *sums)
    whole = staged(whole)
    more = whole.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    whole = whole.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = {"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words")}
    upper = staged(whole.withColumns(own).drop("more", "words"))

    # a node's own sums are added once, on the chain that owns it, to all nodes above it on that chain
    here = F.col("owner") == F.struct("shard", "chain")
    chains = edges.select("key", "shard", "chain").join(upper.select("key", "depth", "owner", "n_leaves", "saved"), "key")
    below = W.partitionBy("shard", "chain").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = [F.sum(F.when(here, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("n_leaves", "saved")]
    totals = chains.select("key", *upto).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))

    above = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("of"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    shared = upper.drop("n_leaves", "saved").join(totals, "key").join(above, "parent", "left").withColumn("parent_conv_id", F.col("of")).select(*columns)
    # each shard gets its own copy of what it needs, so the many children of one node stay with their shards
    of_shard = edges.select("shard", F.col("key").alias("parent")).distinct().join(above, "parent")
    hung = nodes.filter("NOT edge AND parent IS NOT NULL").join(of_shard, ["shard", "parent"]).withColumn("parent_conv_id", F.col("of")).select(*columns)
    out = nodes.filter("NOT edge AND parent IS NULL").select(*columns).union(hung).union(shared)
    return out.select(*columns[:-2], F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))
