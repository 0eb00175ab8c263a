"""Checks that produce issue rows, and checks that stop a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_COLUMNS = ["table_name", "field_name", "issue_type", "raw_value", "record_key", "suggestion"]


class DataCheckError(ValueError):
    """Rows that must not exist do exist."""


def issue(table: str, field: str, kind: str, raw: Column, key: Column, advice: str) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"),
        F.lit(field).alias("field_name"),
        F.lit(kind).alias("issue_type"),
        F.coalesce(raw.cast("string"), F.lit("")).alias("raw_value"),
        key.alias("record_key"),
        F.lit(advice).alias("suggestion"),
    )


def missing_checks(fields: Sequence[str], raw: dict[str, Column], table: str, key: Column, kind: str, advice: str) -> list[Column]:
    """One optional issue per field that is missing."""
    return [F.when(F.col(f).isNull(), issue(table, f, kind, raw[f], key, advice)) for f in fields]


def domain_check(field: str, allowed: Sequence, table: str, key: Column, kind: str, advice: str) -> Column:
    outside = F.col(field).isNull() | ~F.col(field).isin(list(allowed))
    return F.when(outside, issue(table, field, kind, F.col(field), key, advice))


def collect_issues(df: DataFrame, checks: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """All issues of a row in check order, from one pass over the rows."""
    found = F.filter(F.array(*checks), lambda i: i.isNotNull())
    return df.select(*keep, F.posexplode(found).alias("_ordinal", "_issue")).select(*keep, "_ordinal", "_issue.*")


def constraint_violations(df: DataFrame, table: str, rules: dict[str, Column], key: Column) -> DataFrame:
    """Issue rows for columns whose condition is false (NULL passes)."""
    checks = [
        F.when(~F.coalesce(ok, F.lit(True)), issue(table, field, "invalid_format", F.col(field), key, f"{field} out of range"))
        for field, ok in rules.items()
    ]
    return collect_issues(df, checks, keep=[])


def not_one_to_one(df: DataFrame, left: str, right: str) -> DataFrame:
    """Values of either column that belong to more than one value of the other."""
    pairs = df.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).distinct()
    many_l = pairs.groupBy(F.col("l").alias("value")).agg(F.count(F.lit(1)).alias("partners")).filter("partners > 1")
    many_r = pairs.groupBy(F.col("r").alias("value")).agg(F.count(F.lit(1)).alias("partners")).filter("partners > 1")
    return many_l.withColumn("side", F.lit(left)).unionByName(many_r.withColumn("side", F.lit(right)))


def conflicting_values(df: DataFrame, keys: Sequence[str], value: str, sep: str = "/") -> DataFrame:
    """Keys with more than one distinct non-missing value; the sorted values are joined."""
    distinct = df.filter(F.col(value) != "").select(*keys, value).distinct()
    grouped = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("value_count"), F.array_join(F.array_sort(F.collect_list(value)), sep).alias("values")
    )
    return grouped.filter(F.col("value_count") > 1)


def raise_if_any(df: DataFrame, message: str, shown: int = 5) -> None:
    """Stop when the frame has rows; a few of them are shown."""
    bad = df.take(shown)
    if bad:
        raise DataCheckError(f"{message}: {[r.asDict() for r in bad]}")


def split_rows(df: DataFrame, errors: Column, name: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with their error texts)."""
    checked = df.withColumn(name, errors)
    return checked.filter(F.size(name) == 0).drop(name), checked.filter(F.size(name) > 0)
