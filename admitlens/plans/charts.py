"""Aggregates behind charts, and the chart structure itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.plans.trends import latest_year

UNCLASSIFIED = "未分类"


def line_trend(score_lines: DataFrame, by: Sequence[str] = ("university_id", "major_category")) -> DataFrame:
    """Per school, line name and year: the highest total and how many different totals there are."""
    used = score_lines.filter((F.col("line_type") == "major") & (F.col("total_score_line") > 0))
    return used.groupBy(*by, "year").agg(
        F.max("total_score_line").alias("total_score_line"), F.count_distinct("total_score_line").alias("distinct_score_count")
    )


def admission_trend(records: DataFrame, by: Sequence[str] = ("university_id", "major_id"), score: str = "initial_total_score") -> DataFrame:
    """Per school, major and year: lowest, mean and highest score with one decimal."""
    used = records.filter(F.col(score).isNotNull())
    return used.groupBy(*by, "year").agg(
        F.bround(F.min(score), 1).alias("min_score"), F.bround(F.avg(score), 1).alias("avg_score"),
        F.bround(F.max(score), 1).alias("max_score"), F.count(F.lit(1)).alias("record_count"),
    )


def plan_totals(
    plans: DataFrame, majors: DataFrame, university_id: int | None = None, major_category: str | None = None,
    major_code: str | None = None, major_name: str | None = None,
) -> DataFrame:
    """Per year: planned places and number of majors, under optional filters."""
    p = plans.filter(F.col("plan_count").isNotNull())
    if university_id is not None:
        p = p.filter(F.col("university_id") == university_id)
    m = majors
    for column, value in (("major_category", major_category), ("major_code", major_code), ("major_name", major_name)):
        if value is not None:
            m = m.filter(F.col(column) == value)
    joined = p.join(m.select(F.col("id").alias("major_id")), "major_id")
    return joined.groupBy("year").agg(F.sum("plan_count").alias("total_plan"), F.count_distinct("major_id").alias("major_count"))


def category_heat(plans: DataFrame, majors: DataFrame, year: int | None = None, top: int | None = None) -> DataFrame:
    """The categories by planned places in one year (the newest when none is given); the first `top` of them, or all."""
    chosen = latest_year(plans) if year is None else F.lit(year)
    m = majors.filter(F.col("major_category") != "").select(F.col("id").alias("major_id"), F.col("major_category").alias("category"))
    grouped = (
        plans.filter(F.col("year") == chosen)
        .join(m, "major_id")
        .groupBy("category")
        .agg(F.sum("plan_count").alias("total_plan"), F.count(F.lit(1)).alias("major_count"))
    )
    return grouped if top is None else grouped.orderBy(F.desc("total_plan"), F.desc("major_count"), "category").limit(top)


def distribution(df: DataFrame, column: str, unknown: str = UNCLASSIFIED) -> DataFrame:
    """Rows per value; missing and empty values share one label."""
    label = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(unknown))
    return df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("cnt"))


def chart(points: DataFrame, by: Sequence[str], x: str, series: dict[str, str], warnings: Column, numeric_x: bool = True) -> DataFrame:
    """One row per chart: the x values, one array per series (name -> column), messages and the x range.

    A chart has few points (years or labels), so collecting its points is bounded by them.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), *[F.col(c).alias(n) for n, c in series.items()])))
    grouped = points.groupBy(*by).agg(ordered.alias("_points"), warnings.alias("warnings"))
    out = grouped.select(
        *by,
        F.col("_points.x").alias("x_axis"),
        *[F.col(f"_points.{n}").alias(n) for n in series],
        "warnings",
        "_points",
    )
    if numeric_x:
        out = out.withColumns({"min_x": F.array_min("x_axis"), "max_x": F.array_max("x_axis")})
    return out.drop("_points")


def trend_warnings() -> Column:
    """Messages of a line chart (fixed texts), as an aggregate."""
    several = F.max(F.when(F.col("distinct_score_count") > 1, F.lit("同一专业同一年存在多个总分线，图表按最高总分线展示。")))
    single = F.when(F.count(F.lit(1)) < 2, F.lit("仅有 1 个年份的数据，趋势参考意义有限。"))
    return F.filter(F.array(several, single), lambda m: m.isNotNull())
