"""Joins with more than plain equality."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.operators.bloom import prefiltered
from admitlens.operators.keyed import null_safe_join, top_n
from admitlens.sources.stage import staged


def unique_match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join only to right keys that occur exactly once; repeated keys match nothing."""
    payload = [c for c in right.columns if c not in keys]
    single = (
        right.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*payload)).alias("_row"))
        .filter(F.col("_n") == 1)
        .select(*keys, "_row.*")
    )
    return null_safe_join(left, single, keys, how)


def first_code_match(
    left: DataFrame, right: DataFrame, key: Sequence[str], codes: Sequence[str], right_code: str, line: str,
    keep: Callable[[DataFrame], DataFrame] = staged,
) -> DataFrame:
    """Join by the first of several code columns that has a match; the last right row of a key counts.

    Only rows that have a code, and found nothing by the codes before it, are shuffled for it. The lookup, and what is found, are staged (`keep`).
    """
    payload = [c for c in right.columns if c not in (*key, right_code, line)]
    lookup = keep(
        right.filter(F.col(right_code) != "")
        .groupBy(*key, right_code)
        .agg(F.max_by(F.struct(right_code, *payload), F.col(line)).alias("_row"))
    )
    rest, found = keep(left), []
    for code in codes:
        has_code = F.coalesce(F.col(code) != "", F.lit(False))
        side = lookup.select(*key, F.col(right_code).alias(code), "_row")
        asked = keep(null_safe_join(rest.filter(has_code), side, [*key, code], "left"))
        found.append(asked.filter(F.col("_row").isNotNull()))
        rest = rest.filter(~has_code).unionByName(asked.filter(F.col("_row").isNull()).drop("_row"))
    none = F.lit(None).cast(lookup.schema["_row"].dataType)
    out = reduce(DataFrame.unionByName, [*found, rest.withColumn("_row", none)])
    picked = [F.col("_row")[c].alias(c) for c in (right_code, *payload)]
    return out.select(*left.columns, *picked)


def latest_lookup(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, natural: str, value: str) -> DataFrame:
    """Largest value per natural key of the dimension (for example the newest source of a school)."""
    joined = facts.join(dim.select(F.col(dim_key).alias("_k"), natural), F.col(fact_key) == F.col("_k"))
    return joined.groupBy(natural).agg(F.max(value).alias(value))


def resolve(facts: DataFrame, dim: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Natural key -> surrogate id; the dimension has one row per key. Unmatched ids are NULL."""
    return null_safe_join(facts, dim.select(*keys, value), keys, "left")


def unresolved(facts: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the facts that the dimension lacks."""
    return null_safe_join(facts.select(*keys).distinct(), dim.select(*keys), keys, "left_anti")


def substring_matches(needles: DataFrame, needle: str, haystacks: DataFrame, hay: str) -> DataFrame:
    """All (needle, haystack) pairs in which the needle is part of the haystack, by equality.

    Both sides are made distinct first. A haystack is expanded into its substrings of the lengths
    that needles have (one small array), which turns `contains` into a hash join; a filter of the needles drops nearly all substrings that
    are none before anything is shuffled. Meant for names.
    """
    wanted = staged(needles.select(F.col(needle)).filter(F.length(needle) > 0).distinct())
    # The lengths that occur, as one value: a scalar subquery, at most one entry per text length.
    lengths = wanted.agg(F.collect_set(F.length(needle)).alias("_lengths")).scalar()
    names = haystacks.select(F.col(hay)).filter(F.col(hay).isNotNull()).distinct()
    cut = F.flatten(
        F.transform(
            F.filter("_lengths", lambda n: n <= F.length(hay)),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(hay) - n + 1), lambda s: F.substring(F.col(hay), s, n)),
        )
    )
    pieces = names.withColumn("_lengths", lengths).select(hay, F.explode(F.array_distinct(cut)).alias("_piece"))
    near = prefiltered(pieces, "_piece", wanted.withColumnRenamed(needle, "_piece"))
    return near.join(wanted, F.col("_piece") == F.col(needle)).select(needle, hay)


def band_history(
    rows: DataFrame, keys: Sequence[str], year: str, target: str, span: int, payload: Sequence[str], name: str, wanted: DataFrame | None = None,
) -> DataFrame:
    """Per (keys, target year): ordered array of the rows of the last `span` years up to the target.

    With `wanted`, distinct keys and targets, only for these: rows are joined on their keys. Else for all targets: a row of year y belongs
    to the targets y .. y+span-1, so the band becomes an equality.
    """
    if wanted is None:
        met = rows.withColumn(target, F.explode(F.sequence(F.col(year), F.col(year) + (span - 1))))
    else:
        met = rows.join(wanted, list(keys)).filter(F.col(year).between(F.col(target) - (span - 1), F.col(target)))
    item = F.struct(F.col(year).alias("year"), *payload)
    return met.groupBy(*keys, target).agg(F.sort_array(F.collect_list(item)).alias(name))


def first_theta_match(
    left: DataFrame, right: DataFrame, key: str, condition: Column, left_id: Sequence[str], order: Sequence[Column], value: str
) -> DataFrame:
    """One right value per left row: the first in order that meets the condition inside the same key."""
    pairs = left.join(right.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & condition, "left")
    return top_n(pairs, left_id, order).drop("_key")


def skip_completed(work: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key is not completed yet; missing key values equal each other.

    Of the completed keys, which are the history of all runs, only those that may be among the work are shuffled.
    """
    key = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).alias("_key")
    asked = work.select(key)
    known = completed.select(*keys, key)
    return null_safe_join(work, prefiltered(known, "_key", asked).drop("_key"), keys, "left_anti")
