"""What the corpus operators share: input columns, text keys, numbering without a single task, components of links."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from admitlens.sources.stage import release, staged

# The characters that separate words, and so those cut from the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"

LAST_ID = (1 << 63) - 1


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def two_hashes(c: Column) -> tuple[Column, Column]:
    """128 bits in two independent longs, so that equal keys of 10^12 different values are not to be expected."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_buckets(rows: int, per_root: int = 4) -> int:
    """A number of buckets that grows with the square root of the rows, as does then the size of each."""
    return max(1, math.ceil(math.sqrt(rows) / per_root))


def numbered(df: DataFrame, groups: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Add a number from 0 without gaps within each group, however large the group.

    The rows of a group are dealt to buckets by the hash of `order`; a bucket starts where the buckets before
    it end. `df` is read twice: pass a staged table. Rows equal in `order` may change places.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(n_buckets(rows))).cast("int")
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    keys = [*groups, "_bucket"]
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    placed = dealt.join(starts, keys).withColumn(name, F.col("_start") + rank - 1)
    return placed.drop("_bucket", "_start")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of a link.

    Alternating large-star and small-star steps. Each keeps at most the number of links and ends with every
    node linked to the smallest one it can reach; the number of rounds grows with the logarithm of the longest
    path. Smallest neighbours are partial aggregates and are joined as a staged table, so a node with very many
    links is split by adaptive execution.
    """
    both = F.col("u") != F.col("v")
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(both).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        # large star: link every larger neighbour of u to the smallest of u and its neighbours
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = around.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = staged(large.filter(both).distinct())
        release(edges, least)
        # small star: link u and its smaller neighbours to the smallest of them
        least = staged(stars.groupBy("u").agg(F.min("v").alias("m")))
        moved = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.filter(both).distinct())
        release(stars, least)
        now = state(edges)
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select("v", "v").distinct())
