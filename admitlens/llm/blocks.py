"""Comparing the members of groups of any size: pairs of blocks as units of work, streamed through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """Deal the members of each group to blocks of about `block` and send each to every pair its block is in.

    Adds b (the member's block) and (i, j), i <= j, the pair. Any two members of a group meet in one pair only;
    a group of one block is one unit, one of n blocks n * (n + 1) / 2 units that run on different executors.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("b", F.pmod(F.xxhash64(member), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumn("i", F.least("b", "other")).withColumn("j", F.greatest("b", "other")).drop("other")


def side_by_side(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one unit in one task, next to each other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def units(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal keys of sorted batches, each whole, as arrays by column."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch}
        if rest is not None:
            columns = {c: np.concatenate([rest[c], columns[c]]) for c in columns}
        k = np.stack([columns[c] for c in keys])
        at = 0
        for cut in np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1:
            yield {c: v[at:cut] for c, v in columns.items()}
            at = cut
        rest = {c: v[at:] for c, v in columns.items()}
    if rest is not None:
        yield rest


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
