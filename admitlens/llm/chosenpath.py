"""Near-duplicate texts by the Jaccard similarity of their word shingles, found with a chosen-path join.

Each distinct text is a set; min-hash values (coordinate, value) are its tokens. A run deals the sets to
buckets by sampled tokens: a bucket with more than `leaf` sets is split again by tokens chosen for that
bucket, one always and a second with probability 1/threshold - 1, so that a pair at the threshold is
expected to stay together in one branch at every depth. Buckets that are small enough, or as deep as
allowed, are compared by brute force, large ones in pairs of blocks. Runs are repeated until a pair
at the threshold is missed with less than 1 - recall, over all signatures it may have. Candidates are then held against their whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.llm.blocks import block_pairs, roots, side_by_side, units
from admitlens.llm.common import LAST_ID, components, text_of
from admitlens.llm.shingles import set_udf, signature_udf
from admitlens.sources.stage import release, staged


@dataclass(frozen=True)
class ChosenPath:
    """Parameters of the join."""

    width: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    leaf: int = 96
    depth: int = 4
    tokens: int = 64
    #: A candidate's share of equal tokens may lie this many standard deviations below the threshold.
    deviations: float = 3.5
    seed: int = 7

    @property
    def second(self) -> float:
        return 1 / self.threshold - 1

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has met in a bucket of full depth, and is a candidate, with probability `recall`.

        All runs draw from one signature, so the number of its equal tokens is drawn once for all runs.
        """
        equal = [math.comb(self.tokens, n) * self.threshold**n * (1 - self.threshold) ** (self.tokens - n) for n in range(self.tokens + 1)]
        least = max(1, self.least_equal)
        never = sum(equal[:least])
        if never >= 1 - self.recall:
            raise ValueError("recall needs more tokens or deviations")
        lost, runs = [self._lost(n / self.tokens) for n in range(self.tokens + 1)], 1
        while never + sum(equal[n] * lost[n] ** runs for n in range(least, self.tokens + 1)) > 1 - self.recall:
            runs += 1
        return runs

    def _lost(self, share: float) -> float:
        """Probability that a run parts a pair with this share of equal tokens."""
        lost = 0.0
        for _ in range(self.depth):
            one = 1 - share + share * lost
            lost = one * (1 - self.second + self.second * one)
        return lost

    @property
    def least_equal(self) -> int:
        p = self.threshold
        return math.ceil(self.tokens * p - self.deviations * math.sqrt(self.tokens * p * (1 - p)))


def _branches(path: Column, p: ChosenPath) -> Column:
    """The buckets below `path` that a set goes to, by the tokens chosen for that path."""
    token = lambda k: F.pmod(F.xxhash64(path, F.lit(k)), F.lit(p.tokens)).cast("int")
    to = lambda k: F.xxhash64(path, token(k), F.get(F.col("sig"), token(k)))
    twice = F.pmod(F.xxhash64(path, F.lit(0)), F.lit(1 << 20)) < int(p.second * (1 << 20))
    return F.array_compact(F.array(to(1), F.when(twice, to(2))))


def _leaves(nodes: DataFrame, p: ChosenPath) -> DataFrame:
    """(path, c, n): sets in buckets of n sets that are not split further."""
    start = F.explode(F.sequence(F.lit(1), F.lit(p.runs))).alias("run")
    rows = nodes.select("c", "sig", start).select("c", F.explode(_branches(F.xxhash64(F.lit(p.seed), "run"), p)).alias("path"))
    leaves = []
    for depth in range(1, p.depth + 1):
        rows = staged(rows.distinct() if depth > 1 else rows)
        sizes = staged(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        dealt = staged(rows.join(sizes, "path"))
        release(rows, sizes)
        if depth == p.depth:
            leaves.append(dealt)
            break
        leaves.append(dealt.filter(F.col("n") <= p.leaf))
        large = dealt.filter(F.col("n") > p.leaf)
        if large.isEmpty():
            break
        rows = large.join(nodes.select("c", "sig"), "c").select("c", F.explode(_branches(F.col("path"), p)).alias("path"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out


def _compared(p: ChosenPath):
    """Stars of sets that share enough tokens and have sizes that allow the threshold."""
    least, threshold, keys = p.least_equal, p.threshold, ["path", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, keys):
            c, n, sig = unit["c"], unit["m"].astype(float), np.stack(unit["sig"])
            same = np.concatenate([(part[:, None, :] == sig[None, :, :]).sum(axis=2) for part in np.array_split(sig, -(-len(c) // 16))])
            linked = (same >= least) & (np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n))
            np.fill_diagonal(linked, False)
            root = roots(linked)
            joined = root != np.arange(len(root))
            if unit["i"][0] != unit["j"][0]:  # what links within a block join is another unit's: one row for each such part
                joined &= roots(linked & (unit["b"][:, None] == unit["b"][None, :])) == np.arange(len(root))
            at = np.flatnonzero(joined)
            if len(at):
                yield pd.DataFrame({"u": c[at], "v": c[root[at]]})

    return compare


def _verified(threshold: float):
    """For every member of a unit: partners in it at the threshold (weighted by copies), and a star of each part."""
    keys = ["cluster", "i", "j"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, keys):
            c, first = np.unique(unit["c"], return_index=True)
            unit = {k: v[first] for k, v in unit.items()}
            sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"]]
            sizes = np.array([len(s) for s in sets], float)
            shared = _intersections(sets)
            linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
            np.fill_diagonal(linked, False)
            if unit["i"][0] != unit["j"][0]:  # pairs within a block are another unit's
                linked &= unit["b"][:, None] != unit["b"][None, :]
            links = linked @ unit["copies"]
            root = roots(linked)
            at = np.flatnonzero(links > 0)
            if len(at):
                yield pd.DataFrame({"u": c[at], "v": c[root[at]], "links": links[at]})

    return verify


def _intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs, from slices of the incidence matrix."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    times = np.diff(np.append(np.flatnonzero(new), len(values)))
    column = np.cumsum(new) - 1
    several = times[column] > 1  # the rest is in no intersection
    owner, column = owner[several], column[several]
    shared = np.diag([float(len(s)) for s in sets])
    if not len(owner):
        return shared
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    total = np.zeros_like(shared)
    for at in range(0, column[-1] + 1, columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        part = np.zeros((len(sets), min(columns, column[-1] + 1 - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    np.fill_diagonal(total, shared.diagonal())
    return total


def near_duplicates(docs: DataFrame, p: ChosenPath = ChosenPath()) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of the texts of `docs`.

    rows: doc_id, doc (doc_id with null as the largest id) and c (hash of the text) per row of `docs`. classes, per distinct text c:
    n_links (other rows of `docs` with similarity at the threshold, equal texts included) and class_id (smallest
    doc that links reach). A null text is an empty one; a text without words links with nothing but equal texts'
    rows; a text of fewer than `width` words is one shingle. Links between all distinct texts count, in groups of any size.
    """
    body = text_of()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc")
    base = docs.select("doc_id", doc, F.xxhash64(body).alias("c"), body.alias("body"))
    signed = staged(base.select("doc_id", "doc", "c", signature_udf(p.width, p.tokens, p.seed)("body").alias("s")).select("doc_id", "doc", "c", "s.*"))
    rows = signed.select("doc_id", "doc", "c")
    nodes = staged(signed.groupBy("c").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("m"), F.first("sig").alias("sig")))

    leaves = _leaves(nodes.filter("sig IS NOT NULL"), p)
    met = block_pairs(leaves, "path", "c", "n", p.leaf).join(nodes.select("c", "m", "sig"), "c")
    stars = side_by_side(met.select("path", "i", "j", "b", "c", "m", "sig"), ["path", "i", "j"]).mapInPandas(_compared(p), "u long, v long")
    found = staged(components(stars, "u", "v"))  # clusters of candidates

    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = found.join(staged(sizes), "component").select(F.col("component").alias("cluster"), F.col("node").alias("c"), "n")
    members = staged(members.join(nodes.select("c", "doc", "copies"), "c"))
    # a merge join at every size: the texts' share of the shuffle doesn't change with the number of candidates
    sets = staged(base.join(members.hint("merge"), ["c", "doc"]).select("cluster", "c", "n", "copies", set_udf(p.width)("body").alias("shingles")))
    met = block_pairs(sets, "cluster", "c", "n", p.leaf).select("cluster", "i", "j", "b", "c", "copies", "shingles")
    stars = staged(side_by_side(met, ["cluster", "i", "j"]).mapInPandas(_verified(p.threshold), "u long, v long, links long"))
    release(sets)

    links = stars.groupBy(F.col("u").alias("c")).agg(F.sum("links").alias("links"))
    parts = staged(components(stars.filter("u <> v"), "u", "v").withColumnRenamed("node", "c"))
    owned = nodes.select("c", "doc", "copies").join(links, "c", "left").join(parts, "c", "left")
    owned = staged(owned.select("c", "doc", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("part")))
    firsts = staged(owned.groupBy("part").agg(F.min("doc").alias("class_id")))
    return rows, staged(owned.join(firsts, "part").select("c", "n_links", "class_id"))


def links_of_documents(docs: DataFrame, p: ChosenPath = ChosenPath()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_links, class_id and kept (it is the first of its class)."""
    rows, classes = near_duplicates(docs, p)
    return rows.join(classes, "c").select("doc_id", "n_links", "class_id", (F.col("doc") == F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame, p: ChosenPath = ChosenPath()) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest doc_id. Repeated rows of it are one document."""
    rows, classes = near_duplicates(docs, p)
    drop = staged(rows.join(classes, "c").filter("doc <> class_id").select("doc", "c").distinct())
    doc, c = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(text_of())
    packed = docs.select(F.struct("*").alias("row"), doc.alias("doc"), c.alias("c"))
    return packed.join(drop, ["doc", "c"], "left_anti").select("row.*")
