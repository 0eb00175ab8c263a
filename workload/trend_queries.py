"""Trends, statistics and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.functions.scoring import change_rate, stability_from
from admitlens.operators.joins import band_history
from admitlens.operators.keyed import previous_in_order
from admitlens.plans import charts, trends
from admitlens.plans.integrate import rows_per_school_year
from workload.registry import query
from workload.views import Views, half_even, half_up, with_views


def named_plans(v: Views) -> DataFrame:
    """Plans with department and category."""
    p = v.part.select("partkey", "department_name", "major_code", "major_category")
    return v.plans.join(p, "partkey")


def named_lines(v: Views) -> DataFrame:
    """Score lines under the names the statistics use."""
    m = v.majors.select(F.col("id").alias("major_id"), "major_code", "major_name", "research_direction")
    d = v.departments.select(F.col("id").alias("department_id"), "department_name")
    u = v.universities.select(F.col("id").alias("university_id"), F.col("university_name").alias("school_name"))
    lines = v.score_lines.join(m, "major_id").join(d, "department_id").join(u, "university_id")
    return lines.withColumnRenamed("university_id", "school_id")


PLAN_TREND = with_views(
    "plans parts universities",
    f"""SELECT year, university_id, university_name, department_name, major_code, major_category, plan_count, prev AS previous_plan_count,
      CASE WHEN prev <> 0 THEN {half_up('(plan_count - prev)', 'prev', 4)} END AS plan_change_rate
    FROM (SELECT p.*, x.department_name, x.major_code, x.major_category, u.university_name,
      lag(plan_count) OVER (PARTITION BY university_id, major_category ORDER BY year, department_name, major_code) AS prev
      FROM plans p JOIN parts x USING (partkey) JOIN universities u ON u.id = university_id)""",
)


@query("plan_trend", "W1 C17 L8 X5", PLAN_TREND)
def plan_trend(v: Views) -> DataFrame:
    out = trends.plan_trend(named_plans(v), ["university_id", "major_category"], tie=("major_code",))
    u = v.universities.select(F.col("id").alias("university_id"), "university_name")
    return out.join(u, "university_id").select(
        "year", "university_id", "university_name", "department_name", "major_code", "major_category", "plan_count",
        "previous_plan_count", "plan_change_rate",
    )


@query(
    "score_trend", "A1 V9 X5",
    with_views(
        "score_lines majors departments universities",
        """SELECT l.year, l.university_id AS school_id, u.university_name AS school_name, d.department_name, m.major_code, m.major_name,
          m.research_direction, max(total_score_line) AS score_line, max(politics_line) AS politics_line,
          max(english_line) AS english_line, max(subject_one_line) AS subject_one_line, max(subject_two_line) AS subject_two_line,
          1 AS score_line_year_count, CASE WHEN max(total_score_line) IS NOT NULL THEN 'medium' ELSE 'low' END AS data_quality_level
        FROM score_lines l JOIN majors m ON m.id = l.major_id JOIN departments d ON d.id = l.department_id
        JOIN universities u ON u.id = l.university_id WHERE line_type = 'major' GROUP BY ALL""",
    ),
)
def score_trend(v: Views) -> DataFrame:
    return trends.score_trend(named_lines(v))


HEAT = """SELECT p.year, p.university_id AS school_id, x.department_name, x.major_code, x.major_category, x.department_name AS research_direction,
    p.plan_count, p.plan_count + 5.0 AS heat_score
  FROM plans p JOIN parts x USING (partkey) WHERE p.year = (SELECT max(year) FROM plans)"""


def heat_frame(v: Views) -> DataFrame:
    p = v.part.select("partkey", "department_name", "major_code", F.col("department_name").alias("research_direction"))
    plans = v.plans.join(p, "partkey").withColumnRenamed("university_id", "school_id")
    d = v.departments.select(F.col("id").alias("department_id"), "department_name")
    majors = v.majors.join(d, "department_id").withColumnRenamed("university_id", "school_id")
    return trends.major_heat(plans, majors)


@query("major_heat", "J14 C20 X5", with_views("plans parts", HEAT))
def major_heat(v: Views) -> DataFrame:
    return heat_frame(v).select(
        "year", "school_id", "department_name", "major_code", "major_category", "research_direction", "plan_count", "heat_score"
    )


KEY = ["school_id", "major_code"]


def _statistics(v: Views) -> tuple[DataFrame, DataFrame]:
    """Statistics on the (school, major code) key; majors of suppliers without stock value are unknown."""
    p = v.part.select("partkey", "major_code")
    plans = v.plans.join(p, "partkey").withColumnRenamed("university_id", "school_id")
    plan = trends.plan_trend(plans, KEY, within_year=(), tie=())
    score = trends.score_trend(named_lines(v), ["year", *KEY])
    heat = heat_frame(v).select("year", *KEY, "heat_score")
    verified = v.universities.filter(F.col("official_verified_status") == "verified").select(F.col("id").alias("university_id"))
    ids = v.majors.join(verified, "university_id").select(
        F.col("university_id").alias("school_id"), "major_code", "university_id", F.col("id").alias("major_id")
    )
    return trends.major_statistics(plan, score, heat, ids, ["year", *KEY], KEY)


STATISTICS = f"""SELECT p.year, p.university_id, p.major_id, p.plan_count, s.score_line,
    CASE WHEN prev <> 0 THEN {half_up('(p.plan_count - prev)', 'prev', 4)} END AS plan_change_rate, h.heat_score,
    CASE WHEN s.score_line IS NOT NULL AND h.heat_score IS NOT NULL THEN 'high'
         WHEN s.score_line IS NOT NULL OR h.heat_score IS NOT NULL THEN 'medium' ELSE 'low' END AS data_quality_level
  FROM (SELECT *, lag(plan_count) OVER (PARTITION BY university_id, partkey ORDER BY year) AS prev FROM plans) p
  JOIN universities u ON u.id = p.university_id AND u.official_verified_status = 'verified'
  LEFT JOIN (SELECT year, major_id, max(total_score_line) AS score_line FROM score_lines WHERE line_type = 'major' GROUP BY ALL) s
    ON s.year = p.year AND s.major_id = p.major_id
  LEFT JOIN (SELECT year, major_id, plan_count + 5.0 AS heat_score FROM plans WHERE year = (SELECT max(year) FROM plans)) h
    ON h.year = p.year AND h.major_id = p.major_id"""


@query("major_statistics", "J13 V9 X6", with_views("plans universities score_lines", STATISTICS))
def major_statistics(v: Views) -> DataFrame:
    known, _ = _statistics(v)
    return known.drop("admission_count", "min_initial_score", "avg_initial_score", "max_initial_score")


@query(
    "statistics_skipped", "J13 V7",
    with_views(
        "plans universities",
        """SELECT p.year, p.university_id AS school_id, CAST(p.partkey AS VARCHAR) AS major_code FROM plans p
        JOIN universities u ON u.id = p.university_id WHERE u.official_verified_status <> 'verified'""",
    ),
)
def statistics_skipped(v: Views) -> DataFrame:
    return _statistics(v)[1]


DERIVED = """SELECT year, major_category, CAST(round_even(avg(total_score_line - score_diff_to_national), 0) AS INTEGER) AS total_score_line,
    CAST(round_even(avg(politics_line), 0) AS INTEGER) AS politics_line, CAST(round_even(avg(english_line), 0) AS INTEGER) AS english_line,
    CAST(round_even(avg(subject_one_line), 0) AS INTEGER) AS subject_one_line,
    CAST(round_even(avg(subject_two_line), 0) AS INTEGER) AS subject_two_line, count(*) AS sample_count,
    round_even(stddev_samp(total_score_line - score_diff_to_national), 2) AS std_dev
  FROM score_lines WHERE score_diff_to_national <> 0 GROUP BY year, major_category
  HAVING count(*) >= 3 AND round_even(stddev_samp(total_score_line - score_diff_to_national), 2) <= 10"""


@query("national_lines", "A11 X14", with_views("score_lines", DERIVED))
def national_lines(v: Views) -> DataFrame:
    return trends.derived_national_lines(v.score_lines)


@query("national_lines_per_year", "A12", with_views("score_lines", f"SELECT year, count(*) AS line_count FROM ({DERIVED}) GROUP BY year"))
def national_lines_per_year(v: Views) -> DataFrame:
    return trends.lines_per_year(trends.derived_national_lines(v.score_lines))


@query(
    "line_trend", "A2",
    with_views(
        "score_lines",
        """SELECT university_id, major_category, year, max(total_score_line) AS total_score_line,
          count(DISTINCT total_score_line) AS distinct_score_count
        FROM score_lines WHERE line_type = 'major' AND total_score_line > 0 GROUP BY ALL""",
    ),
)
def line_trend(v: Views) -> DataFrame:
    return charts.line_trend(v.score_lines)


@query(
    "line_chart", "X15",
    with_views(
        "score_lines",
        """SELECT university_id, major_category, string_agg(year, ',' ORDER BY year) AS x_axis,
          string_agg(total_score_line, ',' ORDER BY year) AS total_line, min(year) AS min_x, max(year) AS max_x,
          concat_ws('|', CASE WHEN max(n) > 1 THEN '同一专业同一年存在多个总分线，图表按最高总分线展示。' END,
            CASE WHEN count(*) < 2 THEN '仅有 1 个年份的数据，趋势参考意义有限。' END) AS warnings
        FROM (SELECT university_id, major_category, year, max(total_score_line) AS total_score_line, count(DISTINCT total_score_line) AS n
          FROM score_lines WHERE line_type = 'major' AND total_score_line > 0 GROUP BY ALL) GROUP BY university_id, major_category""",
    ),
)
def line_chart(v: Views) -> DataFrame:
    points = charts.line_trend(v.score_lines)
    out = charts.chart(points, ["university_id", "major_category"], "year", {"total_line": "total_score_line"}, charts.trend_warnings())
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), s) for c, s in (("x_axis", ","), ("total_line", ","), ("warnings", "|"))})


def admission_records(v: Views) -> DataFrame:
    """Orders as admission records of the schools their lines name."""
    li = v.table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("university_id"), F.col("l_partkey").alias("partkey"))
    o = v.table("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("initial_total_score"))
    p = v.part.select("partkey", "major_category")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, "partkey")


@query(
    "admission_trend", "A3",
    with_views(
        "parts",
        f"""SELECT university_id, major_category, year, round(min(s), 1) AS min_score, {half_even('sum(s)', 'count(*)', 1)} AS avg_score,
          round(max(s), 1) AS max_score, count(*) AS record_count
        FROM (SELECT l_suppkey AS university_id, major_category, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 1000) AS BIGINT) AS s
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = partkey) GROUP BY ALL""",
    ),
)
def admission_trend(v: Views) -> DataFrame:
    return charts.admission_trend(admission_records(v), ["university_id", "major_category"])


@query(
    "yearly_plan", "A4",
    with_views(
        "plans majors",
        """SELECT p.year, CAST(sum(plan_count) AS BIGINT) AS total_plan, count(DISTINCT p.major_id) AS major_count
        FROM plans p JOIN majors m ON m.id = p.major_id WHERE m.major_category = 'PROMO' GROUP BY p.year""",
    ),
)
def yearly_plan(v: Views) -> DataFrame:
    return charts.plan_totals(v.plans, v.majors, major_category="PROMO")


@query(
    "category_heat_topk", "A5 L6",
    with_views(
        "plans majors",
        """SELECT m.major_category AS category, CAST(sum(plan_count) AS BIGINT) AS total_plan, count(*) AS major_count
        FROM plans p JOIN majors m ON m.id = p.major_id WHERE p.year = (SELECT max(year) FROM plans)
        GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 3""",
    ),
)
def category_heat_topk(v: Views) -> DataFrame:
    return charts.category_heat(v.plans, v.majors, top=3)


@query(
    "distribution", "A6",
    with_views("universities", "SELECT coalesce(nullif(school_level, '普通院校'), '未分类') AS label, count(*) AS cnt FROM universities GROUP BY 1"),
)
def distribution(v: Views) -> DataFrame:
    df = v.universities.withColumn("level", F.when(F.col("school_level") == "普通院校", "").otherwise(F.col("school_level")))
    return charts.distribution(df, "level")


@query(
    "plan_stability", "A21",
    with_views(
        "plans",
        """SELECT university_id, partkey, count(*) AS year_count, CASE WHEN count(*) < 2 THEN 60.0 WHEN avg(plan_count) <= 0 THEN 40.0
          ELSE round(greatest(40.0, least(100.0, 100.0 - stddev_pop(plan_count) / avg(plan_count) * 100.0)), 6) END AS stability
        FROM plans GROUP BY ALL""",
    ),
)
def plan_stability(v: Views) -> DataFrame:
    score = stability_from(F.count("plan_count"), F.avg("plan_count"), F.stddev_pop("plan_count"))
    return v.plans.groupBy("university_id", "partkey").agg(F.count("plan_count").alias("year_count"), F.round(score, 6).alias("stability"))


@query(
    "history_arrays", "W17 J7",
    with_views(
        "plans",
        """SELECT t.major_id, t.year AS target_year, string_agg(h.year || ':' || h.plan_count, ',' ORDER BY h.year) AS history
        FROM plans t JOIN plans h ON h.major_id = t.major_id AND h.year BETWEEN t.year - 2 AND t.year GROUP BY ALL""",
    ),
)
def history_arrays(v: Views) -> DataFrame:
    wanted = v.plans.select("major_id", F.col("year").alias("target_year"))
    history = band_history(v.plans, ["major_id"], "year", "target_year", 3, ["plan_count"], "h")
    text = F.array_join(F.transform("h", lambda i: F.concat_ws(":", i["year"].cast("string"), i["plan_count"].cast("string"))), ",")
    return history.join(wanted, ["major_id", "target_year"], "left_semi").select("major_id", "target_year", text.alias("history"))


@query(
    "yearly_change", "W1",
    with_views(
        "plans",
        f"""SELECT university_id, year, total, prev AS previous_total, CASE WHEN prev <> 0 THEN {half_up('(total - prev)', 'prev', 4)} END AS rate
        FROM (SELECT *, lag(total) OVER (PARTITION BY university_id ORDER BY year) AS prev FROM
          (SELECT university_id, year, CAST(sum(plan_count) AS BIGINT) AS total FROM plans GROUP BY ALL))""",
    ),
)
def yearly_change(v: Views) -> DataFrame:
    totals = v.plans.groupBy("university_id", "year").agg(F.sum("plan_count").alias("total"))
    out = previous_in_order(totals, ["university_id"], ["year"], [], "total", "previous_total")
    return out.withColumn("rate", change_rate(F.col("total"), F.col("previous_total")))


YEARS = range(1992, 2003)  # more than the years of any plan


@query(
    "rows_per_year", "A18",
    with_views(
        "plans",
        f"""SELECT university_id AS school_id, {', '.join(f'count(*) FILTER (year = {y}) AS "{y}"' for y in YEARS)} FROM plans GROUP BY 1""",
    ),
)
def rows_per_year(v: Views) -> DataFrame:
    rows = v.plans.select(F.col("university_id").alias("school_id"), F.col("year").cast("string").alias("year"))
    return rows_per_school_year(rows, [str(y) for y in YEARS]).na.fill(0)
