"""Shards of nearly equal bytes from groups that must stay whole, by Karmarkar-Karp differencing.

A partial partition is one sum of bytes per shard. Differencing repeatedly takes the two partial partitions with the largest
spread and adds the largest sums of one to the smallest of the other. Groups are dealt to buckets of bounded size, each bucket is
differenced to one partial partition in a task of its own, and those are differenced in turn, so many at a time, until few are
left. A bounded number of the largest and of the smallest groups stays out of the buckets: they enter the last differencing one by
one, the large ones before what they unbalance is settled, the small ones to even out what is left. Then the renamings of shards are followed
back down to the groups.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.llm.blocks import units
from admitlens.llm.common import numbered, text_of, two_hashes
from admitlens.sources.stage import staged


@dataclass(frozen=True)
class Sharding:
    """Number of shards, bytes added per row, groups in a bucket, partial partitions combined at a time, and how many of the largest and
    of the smallest groups enter the last differencing singly."""

    shards: int = 40
    overhead: int = 16
    bucket: int = 2048
    fan_in: int = 64
    single: int = 1024


def differenced(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, one row of shard sums each: (sums of the result, shard there of each row's shard).

    Ties are settled by the order of the rows, so equal input gives equal output.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    shape = np.take_along_axis(sums, order, axis=1)
    # a node is a merge: its position j holds position j of its left child and position k - 1 - j, re-sorted, of its right
    left, right, place = {}, {}, {}
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(shape)]
    current = dict(enumerate(shape))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = current.pop(a) + current.pop(b)[::-1]
        by_size = np.argsort(-joined, kind="stable")
        place[made] = np.argsort(by_size)  # where position j of the joined sums ends up
        left[made], right[made] = a, b
        current[made] = joined = joined[by_size]
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), made))
        made += 1
    at = {made - 1: np.arange(k)}  # final shard of each position of a node
    for node in range(made - 1, n - 1, -1):
        final = at.pop(node)[place[node]]
        at[left[node]], at[right[node]] = final, final[::-1]
    to = np.empty((n, k), np.int64)
    for i in range(n):
        to[i, order[i]] = at[i]
    return current[made - 1], to


def _leaf(shards: int):
    """(bucket, key, bytes) -> the shard of each group within its bucket, and the bucket's sums on its first row."""

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, ["bucket"]):
            n = len(unit["bytes"])
            sums = np.zeros((n, shards), np.int64)
            sums[:, 0] = unit["bytes"]
            total, to = differenced(sums)
            out = pd.DataFrame({k: unit[k] for k in ("bucket", "h1", "h2")}).assign(local=to[:, 0].astype(np.int32))
            yield out.assign(sums=[total.tolist(), *[None] * (n - 1)])

    return difference


def _inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(parent, bucket, sums) -> the renaming of each child's shards, and the parent's sums on its first row."""
    for unit in units(batches, ["parent"]):
        total, to = differenced(np.stack(unit["sums"]).astype(np.int64))
        out = pd.DataFrame({k: unit[k] for k in ("parent", "bucket")})
        yield out.assign(to=to.astype(np.int32).tolist(), sums=[total.tolist(), *[None] * (len(out) - 1)])


def _last(shards: int):
    """(parent, bucket, h1, h2, bytes, sums) of the partial partitions and single groups -> the renaming of each one's shards."""

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, ["parent"]):
            n = len(unit["bytes"])
            sums = np.zeros((n, shards), np.int64)
            sums[:, 0] = unit["bytes"]
            for k in np.flatnonzero(unit["bucket"] >= 0):
                sums[k] = unit["sums"][k]
            _, to = differenced(sums)
            yield pd.DataFrame({k: unit[k] for k in ("bucket", "h1", "h2")}).assign(to=to.astype(np.int32).tolist())

    return difference


def _apart(groups: DataFrame, n: int) -> DataFrame:
    """The groups with a column `single`: among the n largest or the n smallest. 2 n rows come to the driver."""
    order = F.struct("bytes", "h1", "h2")
    large = groups.orderBy(order.desc()).limit(n).agg(F.min(order).alias("end")).first()["end"]
    small = groups.orderBy(order).limit(n).agg(F.max(order).alias("end")).first()["end"]
    if large is None or small >= large:
        return groups.withColumn("single", F.lit(True))
    bound = lambda r: F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(("bytes", "h1", "h2"), r)])
    return groups.withColumn("single", (order >= bound(large)) | (order <= bound(small)))


def group_shards(groups: DataFrame, n_groups: int, s: Sharding) -> DataFrame:
    """(h1, h2, shard) for groups (h1, h2, bytes); h1 and h2 name a group."""
    groups = _apart(groups.select("h1", "h2", "bytes"), s.single)
    buckets = max(1, math.ceil((n_groups - 2 * s.single) / s.bucket))
    keyed = groups.filter("NOT single").select(F.pmod("h2", F.lit(buckets)).cast("int").alias("bucket"), "h1", "h2", "bytes")
    sorted_ = keyed.repartition("bucket").sortWithinPartitions("bucket", "h1", "h2")
    leaves = staged(sorted_.mapInPandas(_leaf(s.shards), "bucket int, h1 long, h2 long, local int, sums array<long>"))
    partial, levels = leaves.filter("sums IS NOT NULL").select("bucket", "sums"), []
    while buckets > s.fan_in:
        buckets = math.ceil(buckets / s.fan_in)
        parents = partial.select(F.pmod("bucket", F.lit(buckets)).cast("int").alias("parent"), "bucket", "sums")
        level = staged(parents.repartition("parent").sortWithinPartitions("parent", "bucket").mapInPandas(_inner, "parent int, bucket int, to array<int>, sums array<long>"))
        levels.append(level.select("parent", "bucket", "to"))
        partial = level.filter("sums IS NOT NULL").select(F.col("parent").alias("bucket"), "sums")
    parent, zero = F.lit(0).alias("parent"), F.lit(0).cast("long")
    alone = groups.filter("single").select(parent, F.lit(-1).alias("bucket"), "h1", "h2", "bytes", F.array().cast("array<long>").alias("sums"))
    top = partial.select(parent, "bucket", zero.alias("h1"), zero.alias("h2"), zero.alias("bytes"), "sums").union(alone)
    last = staged(top.repartition(1).sortWithinPartitions("bucket", "h1", "h2").mapInPandas(_last(s.shards), "bucket int, h1 long, h2 long, to array<int>"))
    names = last.filter("bucket >= 0").select("bucket", F.col("to").alias("final"))  # final shard of each shard of a bucket
    for level in reversed(levels):
        up = names.withColumnRenamed("bucket", "parent")
        names = level.join(up, "parent").select("bucket", F.transform("to", lambda x: F.get(F.col("final"), x)).alias("final"))
    dealt = leaves.join(staged(names), "bucket").select("h1", "h2", F.get("final", F.col("local")).alias("shard"))
    return dealt.union(last.filter("bucket < 0").select("h1", "h2", F.get("to", F.lit(0)).alias("shard")))


def shards_of(docs: DataFrame, s: Sharding = Sharding()) -> DataFrame:
    """One row per row of `docs`: doc_id, size (UTF-8 bytes and overhead), text_crc32, shard, slot.

    Rows of equal text are one group and share a shard, a null text counts as an empty one; slots number the rows of a shard from 0
    without gaps. Repeated rows get slots of their own. An empty table gives no rows; other columns are not read.
    """
    body = text_of()
    h1, h2 = two_hashes(body)
    size = (F.octet_length(body) + s.overhead).cast("long")
    rows = staged(docs.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"), h1.alias("h1"), h2.alias("h2")))
    groups = staged(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = staged(group_shards(groups, n_groups, s))
    placed = staged(rows.join(shards, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard"))
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], n_rows, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
