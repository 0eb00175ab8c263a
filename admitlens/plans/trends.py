"""Yearly statistics: score trend, plan trend, heat, combined statistics, derived national lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.functions.scoring import change_rate, heat_score, line_quality, presence_quality
from admitlens.functions.text import float_int, to_float
from admitlens.operators.keyed import null_safe_join, previous_in_order

SUBJECT_LINES = ["politics_line", "english_line", "subject_one_line", "subject_two_line"]
SCORE_KEY = ["year", "school_id", "school_name", "department_name", "major_code", "major_name", "research_direction"]
TREND_KEY = ["school_id", "major_code", "research_direction"]
JOIN_KEY = ["year", "school_id", "department_name", "major_code", "research_direction"]
IDENTITY = ["school_id", "department_name", "major_code", "research_direction"]


def score_trend(score_lines: DataFrame, keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Highest lines of each major per year. Subject lines compare as numbers."""
    lines = score_lines.filter(F.col("line_type") == "major")
    subjects = [F.max(F.col(c).try_cast("int")).alias(c) for c in SUBJECT_LINES]
    grouped = lines.groupBy(*keys).agg(F.max(F.col("total_score_line").try_cast("int")).alias("score_line"), *subjects)
    return grouped.withColumns({"score_line_year_count": F.lit(1), "data_quality_level": line_quality(F.col("score_line"))})


def plan_trend(
    plans: DataFrame, keys: Sequence[str] = TREND_KEY, year: str = "year", count: str = "plan_count",
    within_year: Sequence[str] = ("department_name",), tie: Sequence[str] = ("plan_id",),
) -> DataFrame:
    """Each plan with the count before it in (year, department, plan) order, and the change rate."""
    out = previous_in_order(plans, keys, [year, *within_year], list(tie), count, "previous_plan_count")
    return out.withColumn("plan_change_rate", change_rate(F.col(count), F.col("previous_plan_count")))


def latest_year(df: DataFrame, year: str = "year") -> Column:
    """The newest year, as a scalar subquery."""
    return df.agg(F.max(year)).scalar()


def major_heat(
    plans: DataFrame, majors: DataFrame, keys: Sequence[str] = tuple(IDENTITY), fan_out: bool = False
) -> DataFrame:
    """Heat of the newest year's plans.

    The major side is reduced to one category per key; `fan_out=True` keeps every category row, which
    repeats plans.
    """
    current = plans.filter(F.col("year") == latest_year(plans))
    side = majors.select(*keys, "major_category")
    if not fan_out:
        side = side.groupBy(*keys).agg(F.min("major_category").alias("major_category"))
    joined = null_safe_join(current.drop("major_category"), side, list(keys), "left")
    return joined.withColumns(
        {
            "heat_score": heat_score(F.col("plan_count"), F.col("major_category")),
            "plan_count": F.coalesce("plan_count", F.lit(0)),
        }
    )


def major_statistics(
    plan: DataFrame, score: DataFrame, heat: DataFrame, major_ids: DataFrame, keys: Sequence[str] = tuple(JOIN_KEY),
    identity: Sequence[str] = tuple(IDENTITY),
) -> tuple[DataFrame, DataFrame]:
    """(rows for the statistics table, plan rows whose major is unknown).

    Score and heat have at most one row per key here; the caller reduces them when they have more.
    """
    s = score.select(*keys, float_int(F.col("score_line")).cast("int").alias("score_line"))
    h = heat.select(*keys, to_float(F.col("heat_score")).alias("heat_score"))
    ids = major_ids.select(*identity, "university_id", "major_id")
    plan = plan.select(*dict.fromkeys([*keys, *identity]), "plan_count", "plan_change_rate")
    joined = null_safe_join(null_safe_join(plan, s, list(keys), "left"), h, list(keys), "left")
    known = null_safe_join(joined, ids, list(identity), "inner").select(
        "year", "university_id", "major_id", float_int(F.col("plan_count")).cast("int").alias("plan_count"),
        F.lit(None).cast("int").alias("admission_count"),
        *[F.lit(None).cast("decimal(6,2)").alias(c) for c in ("min_initial_score", "avg_initial_score", "max_initial_score")],
        "score_line", to_float(F.col("plan_change_rate")).alias("plan_change_rate"), "heat_score",
        presence_quality(F.col("score_line"), F.col("heat_score")).alias("data_quality_level"),
    )
    skipped = null_safe_join(plan, ids, list(identity), "left_anti").select(*keys)
    return known, skipped


def one_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last value of each key in the given order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def derived_national_lines(
    score_lines: DataFrame, keys: Sequence[str] = ("year", "major_category"), min_samples: int = 3, max_spread: float = 10.0
) -> DataFrame:
    """National lines worked back from lines and their margin over the national line.

    A group counts with enough samples and a small spread; means are rounded half to even.
    """
    margin = F.col("score_diff_to_national")
    used = score_lines.filter(margin.isNotNull() & (margin != 0)).withColumn("_base", F.col("total_score_line") - margin)
    means = [F.bround(F.avg(c), 0).cast("int").alias(c) for c in SUBJECT_LINES]
    grouped = used.groupBy(*keys).agg(
        F.bround(F.avg("_base"), 0).cast("int").alias("total_score_line"),
        *means,
        F.count(F.lit(1)).alias("sample_count"),
        F.bround(F.stddev_samp("_base"), 2).alias("std_dev"),
    )
    return grouped.filter((F.col("sample_count") >= min_samples) & (F.col("std_dev") <= max_spread))


def lines_per_year(lines: DataFrame) -> DataFrame:
    return lines.groupBy("year").agg(F.count(F.lit(1)).alias("line_count"))
