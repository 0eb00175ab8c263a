"""Mixing sources to target weights with exact quotas of blocks.

The texts of a source, in a random order, form a line of words; up to `most` passes over it follow one another.
The source's target cuts off its part of that line, which is divided into equal blocks. A splitting tree deals
the blocks to output shards: at each node the number of blocks of each source that go left is drawn from the
multivariate hypergeometric distribution, so every shard gets its exact number of blocks and every source uses exactly its
quota. Each shard then takes its own run of the source's permuted blocks, and is shuffled locally. All random
numbers are hashes of a seed and of the row, so reruns agree. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.common import let, n_buckets, text_of
from admitlens.sources.stage import staged


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in order (repeating), passes at most, blocks per shard, words per shard, seed."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    blocks_per_shard: int = 64
    shard_words: int = 1 << 27
    least_shards: int = 16
    seed: int = 11


def sized_units(docs: DataFrame, m: Mix) -> DataFrame:
    """doc_id, source, size (words), h (random order) and the number of equal rows."""
    size = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), _order(docs, m).alias("h"))
    return rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("times"))


def _order(docs: DataFrame, m: Mix) -> Column:
    """A hash of the whole row, so that only rows equal in all columns are one; nulls, which a hash leaves out, are marked."""
    others = []
    for f in docs.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if f.name not in ("doc_id", "source", "text"):
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
            others.append(F.to_json(F.struct(c), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}) if nested else c)
        others.append(c.isNull())
    return F.xxhash64(F.lit(m.seed), "doc_id", "source", text_of(), *others)


def targets(units: DataFrame, m: Mix) -> DataFrame:
    """One row per source: number sid, source_size, target.

    Each source's share of all words is its weight's; a target stops at `most` times the source's size and the excess goes to
    the others by weight. The sources that stop are those of the smallest size for their weight, so
    with sources in that order the first one that need not stop sets the level.
    """
    sizes = staged(units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size")))
    weights = F.array(*map(F.lit, m.weights))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("w", F.get(weights, F.col("sid") % len(m.weights)))
    capped = named.withColumn("cap", m.most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "sid")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = capped.withColumn("level", level).withColumn("stops", F.col("level") * F.col("w") > F.col("cap"))
    least = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(whole)["level"]
    return levels.select("source", "sid", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(least * F.col("w")).cast("double").alias("target"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def _hypergeometric(all_: Column, ours: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` blocks out of `all_` are among `ours`: inverse of the distribution, walked from its mode.

    Probabilities relative to the mode's follow from the ratio of neighbours; beyond 14 deviations they vanish.
    """
    mean = drawn * ours / F.greatest(all_, F.lit(1))
    span = F.ceil(14 * F.sqrt(mean + 1)).cast("long") + 4
    lo, hi = F.greatest(F.lit(0), drawn - (all_ - ours)), F.least(drawn, ours)
    mode = F.least(F.greatest(F.floor((drawn + 1.0) * (ours + 1.0) / (all_ + 2.0)), lo), hi)

    def up(k: Column) -> Column:  # f(k + 1) / f(k)
        return (ours - k).cast("double") * (drawn - k) / ((k + 1.0) * (all_ - ours - drawn + k + 1))

    def walk(mode: Column) -> Column:
        """(k, f) of the values above and below the mode."""
        start = F.struct(F.lit(1.0).alias("f"), F.array(F.struct(mode.alias("k"), F.lit(1.0).alias("f"))).alias("seen"))

        def step(acc: Column, k: Column, f: Column) -> Column:
            return F.struct(f.alias("f"), F.array_append(acc["seen"], F.struct(k.alias("k"), f.alias("f"))).alias("seen"))

        above = F.when(hi > mode, F.sequence(mode + 1, F.least(hi, mode + span))).otherwise(F.array().cast("array<bigint>"))
        below = F.when(lo < mode, F.sequence(mode - 1, F.greatest(lo, mode - span), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        rise = F.aggregate(above, start, lambda acc, k: step(acc, k, acc["f"] * up(k - 1)))
        fall = F.aggregate(below, start, lambda acc, k: step(acc, k, acc["f"] / up(k)))
        return F.concat(rise["seen"], F.slice(fall["seen"], 2, 1 << 30))

    def pick(seen: Column) -> Column:
        mass = F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + x["f"])
        start = F.struct((u * mass).alias("rest"), F.lit(None).cast("bigint").alias("k"))
        found = F.aggregate(seen, start, lambda acc, x: F.struct((acc["rest"] - x["f"]).alias("rest"), F.coalesce(acc["k"], F.when(acc["rest"] <= x["f"], x["k"])).alias("k")))["k"]
        return F.coalesce(found, F.element_at(seen, 1)["k"])

    return let(mode.cast("long"), lambda mode: let(walk(mode), pick))


def _left_quotas(quotas: Column, n_left: Column, lo: Column, hi: Column, m: Mix) -> Column:
    """Blocks of each source that go to the left child, source after source."""
    total = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda acc, q: acc + q["k"])
    start = F.struct(total.alias("all"), n_left.cast("bigint").alias("drawn"), F.array().cast("array<struct<sid:int,k:bigint>>").alias("out"))

    def draw(acc: Column, q: Column) -> Column:
        u = _uniform(F.lit(m.seed), lo, hi, q["sid"])
        return let(_hypergeometric(acc["all"], q["k"], acc["drawn"], u), lambda x: F.struct(
            (acc["all"] - q["k"]).alias("all"), (acc["drawn"] - x).alias("drawn"),
            F.array_append(acc["out"], F.struct(q["sid"].alias("sid"), x.alias("k"))).alias("out"),
        ))

    return F.aggregate(quotas, start, draw)["out"]


def shard_quotas(sources: DataFrame, shards: int, m: Mix) -> DataFrame:
    """(sid, shard, k): the splitting tree over the sources' numbers of blocks (one row per node)."""
    root = sources.agg(F.array_sort(F.collect_list(F.struct(F.col("sid").cast("int").alias("sid"), F.col("blocks").cast("bigint").alias("k")))).alias("quotas"), F.sum("blocks").alias("total"))
    nodes = root.filter("total > 0").select("quotas", "total", F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"))
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        upto = lambda j: F.floor(j * F.col("total") / F.lit(shards))  # noqa: E731  blocks of all shards before j
        left = _left_quotas(F.col("quotas"), upto(mid) - upto(F.col("lo")), F.col("lo"), F.col("hi"), m)
        right = F.transform(F.arrays_zip(F.col("quotas"), F.col("left")), lambda x: F.struct(x["quotas"]["sid"].alias("sid"), (x["quotas"]["k"] - x["left"]["k"]).alias("k")))
        split = nodes.withColumn("mid", mid).withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        alone = F.array(F.struct("lo", "hi", "quotas"))
        two = F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("quotas")), F.struct(F.col("mid").alias("lo"), "hi", right.alias("quotas")))
        nodes = staged(split.select("total", F.explode(F.when(F.col("left").isNull(), alone).otherwise(two)).alias("n")).select("total", "n.*"))
    return nodes.select(F.col("lo").alias("shard"), F.explode("quotas").alias("q")).select("q.sid", "shard", "q.k").filter("k > 0")


def _dealt_blocks(sources: DataFrame, shards: int, m: Mix) -> DataFrame:
    """(sid, block, shard): each shard takes the next run of its source's permuted blocks."""
    quotas = shard_quotas(sources, shards, m)
    before = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = quotas.withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    places = runs.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("place"))
    blocks = sources.filter("blocks > 0").select("sid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    shuffled = W.partitionBy("sid").orderBy(F.xxhash64(F.lit(m.seed), "sid", "block"), "block")
    return blocks.withColumn("place", (F.row_number().over(shuffled) - 1).cast("bigint")).join(places, ["sid", "place"]).select("sid", "block", "shard")


def draws(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, h and taken: an array of (shard, at), one entry for
    each time the mix takes the text; shards are read in the order of `at`.

    A null text has no words. A null source is a source, the last one. A text of no words is never needed to meet
    a target but may be drawn. Repeated rows are drawn one by one. An empty table gives no rows; no text is taken more than `most` times.
    """
    units = staged(sized_units(docs, m))
    goals = staged(targets(units, m))
    total, rows = units.agg(F.sum(F.col("size") * F.col("times")), F.sum("times")).first()
    shards = max(m.least_shards, math.ceil((total or 0) / m.shard_words))
    words = max(1.0, (total or 0) / (shards * m.blocks_per_shard))
    sources = staged(goals.withColumn("blocks", F.ceil(F.col("target") / words).cast("bigint")))
    one = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("nth")
    bucket = F.pmod(F.col("h"), F.lit(n_buckets(rows or 0))).cast("int")
    lined = units.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "h", "sid", "source_size", "target", "blocks", bucket.alias("bucket"), one)
    lined = staged(lined)
    sums = lined.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    within = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "nth").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    ordered = lined.join(starts, ["sid", "bucket"]).withColumn("middle", middle)
    passes = F.explode_outer(F.filter(F.sequence(F.lit(0), F.lit(m.most - 1)), lambda e: e * F.col("source_size") + F.col("middle") < F.col("target"))).alias("pass")
    copies = ordered.select("doc_id", "size", "h", "nth", "sid", "source_size", "target", "blocks", passes, "middle")
    along = (F.col("pass") * F.col("source_size") + F.col("middle")) * F.col("blocks") / F.col("target")
    copies = copies.withColumn("block", F.when(F.col("pass").isNotNull(), F.least(F.floor(along), F.col("blocks") - 1)))
    placed = copies.join(staged(_dealt_blocks(sources, shards, m)), ["sid", "block"], "left")
    at = F.xxhash64(F.lit(m.seed + 1), "shard", "doc_id", "h", "nth", "pass")
    entry = F.when(F.col("shard").isNotNull(), F.struct("shard", at.alias("at")))
    keys = ["doc_id", "size", "h", "nth", "source_size", "target"]
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("taken"))


def mixed(docs: DataFrame, m: Mix = Mix(), slices: int = 16) -> DataFrame:
    """`docs` as the mix takes them, all columns kept: rows repeated or left out, shard by shard, shuffled within.

    Written to files, the rows of one shard are in at most `slices` of them.
    """
    plan = draws(docs, m).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("taken")).alias("taken"), F.count(F.lit(1)).alias("times"))
    plan = staged(plan.filter(F.size("taken") > 0).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "h", "taken", "times"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), _order(docs, m).alias("h"))
    single = rows.join(plan.filter("times = 1"), ["id", "h"]).select("row", "taken")
    if not plan.filter("times > 1").isEmpty():  # equal rows share one entry: it goes to one of them
        several = rows.join(plan.filter("times > 1"), ["id", "h"]).dropDuplicates(["id", "h"])
        single = single.union(several.select("row", "taken"))
    out = single.select("row", F.explode("taken").alias("t"))
    slice_ = F.pmod("t.at", F.lit(slices))
    return out.repartition(F.col("t.shard"), slice_).sortWithinPartitions("t.shard", slice_, "t.at").select("row.*")
