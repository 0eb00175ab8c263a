"""Keyed de-duplication, top-n, numbering and lag.

None of these gathers a whole key in one task. `row_number() <= n` is pushed below the
shuffle by Spark (window group limit), so a key that holds a third of all rows sends at
most n rows per map task; operators that need every row of a key split the key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.sources.stage import release, staged


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def top_n(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """The first n rows of each key in a total order. NULL keys are equal to each other."""
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_wins(df: DataFrame, keys: Sequence[str | Column], line: str) -> DataFrame:
    return top_n(df, keys, [F.col(line).asc()])


def last_wins(df: DataFrame, keys: Sequence[str | Column], line: str) -> DataFrame:
    return top_n(df, keys, [F.col(line).desc()])


def best_row(df: DataFrame, keys: Sequence[str | Column], rank: Sequence[Column], line: str) -> DataFrame:
    """Smallest rank wins; the earliest line on ties."""
    return top_n(df, keys, [*rank, F.col(line).asc()])


def later_rows(df: DataFrame, keys: Sequence[str | Column], line: str) -> DataFrame:
    """Every row but the first of its key: the duplicates `first_wins` leaves out.

    The first line of a key is a partial aggregate. Only keys that repeat are joined back; they are staged, so that few of them are
    known to be few before the rows are shuffled. The join is split by adaptive execution where a key is hot.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, _cols(keys))))
    counted = keyed.groupBy(*names).agg(F.min(line).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = staged(counted.filter(F.col("_n") > 1).drop("_n"))
    return null_safe_join(keyed, repeated, names, "inner").filter(F.col(line) > F.col("_first")).drop(*names, "_first")


def surplus_count(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """One row: how many rows the keys have beyond their first."""
    per_key = df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(_cols(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def previous_in_order(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """`lag(value)` over `keys` in the order (buckets, order), with the key split at bucket borders.

    The lag runs inside (key, bucket). Only the first row of a bucket needs another bucket's
    last value, and there is one such value per bucket. Without `order` columns (key, bucket) is unique,
    so a key has one row per period and a plain window is enough.
    """
    if not order:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*buckets)))
    key_cols = [*keys, *buckets]
    inside = Window.partitionBy(*key_cols).orderBy(*order)
    local = df.withColumn(name, F.lag(value).over(inside)).withColumn("_pos", F.row_number().over(inside))
    last = df.groupBy(*key_cols).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy(*buckets)
    borders = last.select(*key_cols, F.lag(F.col("_last")["v"]).over(across).alias("_border"))
    joined = null_safe_join(local, borders, key_cols, "left")
    return joined.withColumn(name, F.when(F.col("_pos") == 1, F.col("_border")).otherwise(F.col(name))).drop(
        "_pos", "_border"
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match; the left side's key columns are kept.

    Null-safe keys are shuffled on both sides, which also lets adaptive execution split a hot left key
    when the right side is an aggregate.
    """
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def with_offsets(rows: DataFrame, name: str, start: int) -> DataFrame:
    """Number staged rows from `start` by (`_part`, `_pos`), where positions of a part have no gaps.

    The offsets of the parts are broadcast: there is one row per task that wrote the table, however many rows it has.
    """
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.withColumn(name, F.col("_off") + F.col("_pos") + start).drop("_part", "_pos", "_p", "_off")


def with_places(df: DataFrame) -> DataFrame:
    """`_part` and `_pos`: the task that holds a row, and the row's number there. Stage the result before it is used twice."""
    base = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mid", 33)
    return base.withColumn("_part", part).withColumn("_pos", F.col("_mid") - F.shiftleft(part, 33)).drop("_mid")


def numbered_in(df: DataFrame, order: Sequence[Column], name: str, start: int = 1, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows numbered in a total order without sorting everything in one task.

    Rows are dealt by ranges of that order, as Spark samples it, so neither gaps nor clusters matter; a task's rows are numbered behind
    those of the tasks before it. They are staged first: the sample is then taken from a scan, and what made the rows runs once.
    Staged tables that nothing else reads (`spent`) are removed then.
    """
    rows = staged(df)
    release(*spent)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(with_places(ranges))
    release(rows)
    return with_offsets(numbered, name, start)


def consecutive_ids(
    df: DataFrame, stage: str, position: str, tie: Sequence[str], name: str, spent: Sequence[DataFrame] = ()
) -> DataFrame:
    """1..n in the order (stage, position, tie)."""
    return numbered_in(df, [F.col(c) for c in (stage, position, *tie)], name, spent=spent)


def new_key_ids(df: DataFrame, known: DataFrame, keys: Sequence[str], line: str, name: str) -> DataFrame:
    """Preview ids -1, -2, .. for keys that are not known yet, in order of first appearance."""
    firsts = df.groupBy(*keys).agg(F.min(line).alias("_first"))
    unseen = null_safe_join(firsts, known.select(*keys), keys, "left_anti").withColumn("_stage", F.lit(0))
    ids = consecutive_ids(unseen, "_stage", "_first", list(keys), "_id")
    return ids.select(*keys, (-F.col("_id")).alias(name))
