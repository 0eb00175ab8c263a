"""The domain tables as views over the given tables, for Spark and for the SQL oracle.

universities = suppliers; majors = the (supplier, part) pairs that occur in lineitem; departments = brands of a
supplier; plans = quantities per (year, supplier, part); score lines = prices, by return flag A (major lines),
N (university lines) and R (national lines); applicants = orders.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitlens.functions.codes import coverage_priority


def whole(c: Column, by: int = 1) -> Column:
    return F.floor(c / by).cast("int") if by != 1 else F.floor(c).cast("int")


class Views:
    """Lazy views over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def universities(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        s = self.table("supplier")
        joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        level = (
            F.when(F.col("s_acctbal") >= 8000, "985 / 211 / 双一流")
            .when(F.col("s_acctbal") >= 6000, "211 / 双一流")
            .when(F.col("s_acctbal") >= 4000, "双一流")
            .otherwise("普通院校")
        )
        kind = F.when(F.col("s_nationkey") < 8, "综合").when(F.col("s_nationkey") < 16, "理工").otherwise("师范")
        return joined.select(
            F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("candidate_school_id"), F.col("s_name").alias("university_name"),
            F.col("n_name").alias("province"), F.concat(F.col("n_name"), F.lit(" city")).alias("city"),
            F.col("r_name").alias("province_area"), kind.alias("school_type"), level.alias("school_level"),
            coverage_priority(level).alias("coverage_priority"), F.lit(None).cast("string").alias("official_site"),
            F.when(F.col("s_acctbal") < 0, "pending").otherwise("verified").alias("official_verified_status"),
        )

    @cached_property
    def part(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("partkey"), F.col("p_partkey").cast("string").alias("major_code"),
            F.col("p_name").alias("major_name"), F.col("p_type").alias("major_category"), F.col("p_brand").alias("department_name"),
            F.substring("p_brand", 7, 10).cast("int").alias("brand_no"), size,
            F.when(size <= 25, "academic").otherwise("professional").alias("degree_type"),
            F.when(size <= 40, "full_time").otherwise("part_time").alias("study_mode"),
        )

    @cached_property
    def offers(self) -> DataFrame:
        """Distinct (supplier, part) pairs with the part's columns."""
        pairs = self.table("lineitem").select(F.col("l_suppkey").alias("university_id"), F.col("l_partkey").alias("partkey")).distinct()
        return pairs.join(self.part, "partkey").withColumns(
            {
                "id": F.col("university_id") * 1000000000 + F.col("partkey"),
                "department_id": F.col("university_id") * 100 + F.col("brand_no"),
            }
        )

    @cached_property
    def majors(self) -> DataFrame:
        return self.offers.select(
            "id", "university_id", "department_id", "major_code", "major_name", "major_category", "degree_type", "study_mode",
            F.col("department_name").alias("research_direction"),
            F.concat_ws(" ", "major_name", "department_name").alias("exam_subjects"),
        )

    @cached_property
    def departments(self) -> DataFrame:
        return self.offers.select(F.col("department_id").alias("id"), "university_id", "department_name").distinct()

    @cached_property
    def plans(self) -> DataFrame:
        li = self.table("lineitem")
        grouped = li.groupBy(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("university_id"), F.col("l_partkey").alias("partkey")).agg(
            F.sum("l_quantity").cast("int").alias("plan_count")
        )
        return grouped.withColumn("major_id", F.col("university_id") * 1000000000 + F.col("partkey"))

    @cached_property
    def score_lines(self) -> DataFrame:
        li = self.table("lineitem").join(self.part, F.col("l_partkey") == F.col("partkey")).select(
            F.year("l_shipdate").alias("year"), "l_returnflag", F.col("l_suppkey").alias("university_id"), "partkey", "brand_no",
            "major_name", "major_category", "p_size", whole(F.col("l_extendedprice"), 210).alias("total"),
        )
        total = F.max("total").alias("total_score_line")
        none_long, none_int = F.lit(None).cast("bigint"), F.lit(None).cast("int")
        major = (
            li.filter(F.col("l_returnflag") == "A")
            .groupBy("year", "university_id", "partkey", "brand_no", "major_name", "p_size").agg(total)
            .select(
                F.concat_ws("-", "year", F.lit("major"), "university_id", "partkey").alias("id"), "year", F.lit("major").alias("line_type"),
                "university_id", (F.col("university_id") * 100 + F.col("brand_no")).alias("department_id"),
                (F.col("university_id") * 1000000000 + F.col("partkey")).alias("major_id"), F.col("major_name").alias("major_category"),
                "total_score_line",
                (F.col("total_score_line") - 250 - whole(F.col("p_size") * 7, 10)).alias("score_diff_to_national"),
                F.when(F.col("p_size") <= 45, whole(F.col("total_score_line") * 20, 100)).alias("subject_two_line"),
            )
        )
        school = (
            li.filter(F.col("l_returnflag") == "N").groupBy("year", "university_id", "major_category").agg(total)
            .select(
                F.concat_ws("-", "year", F.lit("university"), "university_id", "major_category").alias("id"), "year",
                F.lit("university").alias("line_type"), "university_id", none_long.alias("department_id"), none_long.alias("major_id"),
                "major_category", "total_score_line", none_int.alias("score_diff_to_national"), none_int.alias("subject_two_line"),
            )
        )
        nation = (
            li.filter(F.col("l_returnflag") == "R").groupBy("year", "major_category").agg(total)
            .select(
                F.concat_ws("-", "year", F.lit("national"), "major_category").alias("id"), "year", F.lit("national").alias("line_type"),
                none_long.alias("university_id"), none_long.alias("department_id"), none_long.alias("major_id"), "major_category",
                "total_score_line", F.lit(0).alias("score_diff_to_national"), none_int.alias("subject_two_line"),
            )
        )
        t = F.col("total_score_line")
        return major.unionByName(school).unionByName(nation).withColumns(
            {"politics_line": whole(t * 12, 100), "english_line": whole(t * 13, 100), "subject_one_line": whole(t * 20, 100)}
        )

    @cached_property
    def rates(self) -> DataFrame:
        pairs = self.offers.select("university_id", "major_name").distinct()
        spot = F.pmod(F.col("university_id") + F.length("major_name"), F.lit(7))
        grade = F.element_at(F.array(*[F.lit(x) for x in ("A+", "A", "A-", "B+", "B", "B-")]), (spot + 1).cast("int"))
        return pairs.select(
            F.concat_ws("-", "university_id", "major_name").alias("id"), "university_id", F.col("major_name").alias("subject_code"),
            F.concat(F.lit("studies of "), F.col("major_name")).alias("subject_name"), F.when(spot < 6, grade).alias("level_rate"),
        )

    @cached_property
    def applicants(self) -> DataFrame:
        """Every order is an applicant; the priority decides which filters are filled in."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        joined = (
            o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.part, F.col("o_custkey") == F.col("partkey"))
        )
        pri = F.substring("o_orderpriority", 1, 1)
        score = whole(F.col("o_totalprice"), 1000)
        levels = F.array(F.lit("985"), F.lit("双一流"))
        return joined.select(
            F.col("o_orderkey").alias("applicant_id"),
            F.year("o_orderdate").alias("target_year"),
            F.when(pri.isin("2", "3", "4"), F.col("n_name")).alias("province"),
            F.when(pri == "1", F.col("major_code")).alias("major_code"),
            F.when(pri.isin("2", "5"), F.col("major_name")).alias("major_name"),
            F.when(pri.isin("3", "4"), F.col("major_category")).alias("major_category"),
            F.when(pri == "3", F.col("degree_type")).alias("degree_type"),
            F.when(pri == "4", F.col("study_mode")).alias("study_mode"),
            F.when(pri == "4", levels).alias("preferred_school_levels"),
            score.alias("total_score"),
            whole(score * 17, 100).alias("politics_score"),
            whole(score * 16, 100).alias("english_score"),
            F.when(pri != "5", whole(score * 22, 100)).alias("subject_one_score"),
            F.when(pri != "5", whole(score * 21, 100)).alias("subject_two_score"),
            F.when(pri == "1", F.lit(3)).alias("bucket_limit"),
        )


# The same views as SQL (DuckDB dialect), in dependency order.
SQL_VIEWS = {
    "universities": """
        SELECT s_suppkey AS id, s_suppkey AS candidate_school_id, s_name AS university_name, n_name AS province,
          n_name || ' city' AS city, r_name AS province_area,
          CASE WHEN s_nationkey < 8 THEN '综合' WHEN s_nationkey < 16 THEN '理工' ELSE '师范' END AS school_type,
          CASE WHEN s_acctbal >= 8000 THEN '985 / 211 / 双一流' WHEN s_acctbal >= 6000 THEN '211 / 双一流'
               WHEN s_acctbal >= 4000 THEN '双一流' ELSE '普通院校' END AS school_level,
          CASE WHEN s_acctbal >= 8000 THEN 'P0' WHEN s_acctbal >= 4000 THEN 'P1' ELSE 'P2' END AS coverage_priority,
          CAST(NULL AS VARCHAR) AS official_site,
          CASE WHEN s_acctbal < 0 THEN 'pending' ELSE 'verified' END AS official_verified_status
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "parts": """
        SELECT p_partkey AS partkey, CAST(p_partkey AS VARCHAR) AS major_code, p_name AS major_name, p_type AS major_category,
          p_brand AS department_name, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, p_size,
          CASE WHEN p_size <= 25 THEN 'academic' ELSE 'professional' END AS degree_type,
          CASE WHEN p_size <= 40 THEN 'full_time' ELSE 'part_time' END AS study_mode
        FROM part""",
    "offers": """
        SELECT x.university_id, p.*, x.university_id * 1000000000 + p.partkey AS id,
          x.university_id * 100 + p.brand_no AS department_id
        FROM (SELECT DISTINCT l_suppkey AS university_id, l_partkey AS partkey FROM lineitem) x JOIN parts p USING (partkey)""",
    "majors": """
        SELECT id, university_id, department_id, major_code, major_name, major_category, degree_type, study_mode,
          department_name AS research_direction, major_name || ' ' || department_name AS exam_subjects FROM offers""",
    "departments": """
        SELECT DISTINCT department_id AS id, university_id, department_name FROM offers""",
    "plans": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS university_id, l_partkey AS partkey,
          CAST(sum(l_quantity) AS INTEGER) AS plan_count, l_suppkey * 1000000000 + l_partkey AS major_id
        FROM lineitem GROUP BY ALL""",
    "raw_lines": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, l_suppkey AS university_id, p.*,
          CAST(floor(l_extendedprice / 210) AS INTEGER) AS total
        FROM lineitem JOIN parts p ON l_partkey = p.partkey""",
    "score_lines": """
        SELECT *, total_score_line * 12 // 100 AS politics_line, total_score_line * 13 // 100 AS english_line,
          total_score_line * 20 // 100 AS subject_one_line
        FROM (
          SELECT year || '-major-' || university_id || '-' || partkey AS id, year, 'major' AS line_type, university_id,
            university_id * 100 + brand_no AS department_id, university_id * 1000000000 + partkey AS major_id,
            major_name AS major_category, max(total) AS total_score_line,
            max(total) - 250 - p_size * 7 // 10 AS score_diff_to_national,
            CASE WHEN p_size <= 45 THEN max(total) * 20 // 100 END AS subject_two_line
          FROM raw_lines WHERE l_returnflag = 'A' GROUP BY year, university_id, partkey, brand_no, major_name, p_size
          UNION ALL
          SELECT year || '-university-' || university_id || '-' || major_category, year, 'university', university_id, NULL, NULL,
            major_category, max(total), NULL, NULL
          FROM raw_lines WHERE l_returnflag = 'N' GROUP BY year, university_id, major_category
          UNION ALL
          SELECT year || '-national-' || major_category, year, 'national', NULL, NULL, NULL, major_category, max(total), 0, NULL
          FROM raw_lines WHERE l_returnflag = 'R' GROUP BY year, major_category)""",
    "rates": """
        SELECT university_id || '-' || major_name AS id, university_id, major_name AS subject_code,
          'studies of ' || major_name AS subject_name,
          CASE (university_id + length(major_name)) % 7 WHEN 0 THEN 'A+' WHEN 1 THEN 'A' WHEN 2 THEN 'A-' WHEN 3 THEN 'B+'
            WHEN 4 THEN 'B' WHEN 5 THEN 'B-' END AS level_rate
        FROM (SELECT DISTINCT university_id, major_name FROM offers)""",
    "applicants": """
        SELECT o_orderkey AS applicant_id, CAST(year(o_orderdate) AS INTEGER) AS target_year,
          CASE WHEN pri IN ('2', '3', '4') THEN n_name END AS province,
          CASE WHEN pri = '1' THEN major_code END AS major_code,
          CASE WHEN pri IN ('2', '5') THEN major_name END AS major_name,
          CASE WHEN pri IN ('3', '4') THEN major_category END AS major_category,
          CASE WHEN pri = '3' THEN degree_type END AS degree_type,
          CASE WHEN pri = '4' THEN study_mode END AS study_mode,
          pri = '4' AS wants_level,
          score AS total_score, score * 17 // 100 AS politics_score, score * 16 // 100 AS english_score,
          CASE WHEN pri <> '5' THEN score * 22 // 100 END AS subject_one_score,
          CASE WHEN pri <> '5' THEN score * 21 // 100 END AS subject_two_score,
          CASE WHEN pri = '1' THEN 3 ELSE 5 END AS bucket_limit
        FROM (SELECT *, substr(o_orderpriority, 1, 1) AS pri, CAST(floor(o_totalprice / 1000) AS INTEGER) AS score FROM orders)
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN parts ON o_custkey = partkey""",
    "described": """
        SELECT l.id AS score_line_id, l.year, l.line_type, l.university_id, l.department_id, l.major_id,
          l.major_category AS score_major_category, l.total_score_line, l.score_diff_to_national, l.politics_line, l.english_line,
          l.subject_one_line, l.subject_two_line, u.candidate_school_id, u.university_name, u.province, u.school_level,
          d.department_name, m.major_code, m.major_name, m.major_category, m.degree_type, m.study_mode
        FROM score_lines l LEFT JOIN universities u ON u.id = l.university_id LEFT JOIN departments d ON d.id = l.department_id
        LEFT JOIN majors m ON m.id = l.major_id""",
}

_NEEDS = {
    "offers": ["parts"],
    "majors": ["offers"],
    "departments": ["offers"],
    "raw_lines": ["parts"],
    "score_lines": ["raw_lines"],
    "rates": ["offers"],
    "applicants": ["parts"],
    "described": ["score_lines", "universities", "departments", "majors"],
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """`body` behind WITH clauses for the named views and what they need."""
    needed: set[str] = set()

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        needed.add(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({sql})" for n, sql in SQL_VIEWS.items() if n in needed]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def half_up(num: str, den: str, digits: int) -> str:
    """SQL for round-half-up of an integer quotient, without floating-point ties."""
    p = 10**digits
    return f"(sign({num} * {den}) * ((2 * abs({num}) * {p} + abs({den})) // (2 * abs({den}))) / {p}.0)"


def half_even(num: str, den: str, digits: int) -> str:
    """SQL for round-half-even of a non-negative integer quotient."""
    p = 10**digits
    q = f"(({num}) * {p})"
    up = f"CASE WHEN 2 * ({q} % ({den})) > ({den}) OR (2 * ({q} % ({den})) = ({den}) AND ({q} // ({den})) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(({q} // ({den}) + {up}) / {p}.0)"
