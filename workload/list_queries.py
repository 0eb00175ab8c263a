"""Lists, options, searches, counts and school profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.functions.output import output_types
from admitlens.functions.text import any_contains
from admitlens.plans import catalog
from workload.registry import query
from workload.views import Views, with_views


@query(
    "universities_page", "F1 F10 L2 L3",
    with_views(
        "universities",
        """SELECT id, university_name, coverage_priority, CASE WHEN id = 7 THEN 'https://example.org/7' END AS official_site,
          (SELECT count(*) FROM universities WHERE official_verified_status = 'verified' AND contains(university_name, '0')) AS total,
          60 < (SELECT count(*) FROM universities WHERE official_verified_status = 'verified' AND contains(university_name, '0')) AS has_more
        FROM universities WHERE official_verified_status = 'verified' AND contains(university_name, '0')
        ORDER BY list_position(['P0', 'P1', 'P2', 'P3'], coverage_priority), candidate_school_id, id LIMIT 50 OFFSET 10""",
    ),
)
def universities_page(v: Views) -> DataFrame:
    found = catalog.filter_universities(v.universities, official_verified_status="verified", keyword="0")
    rows = catalog.page(found, catalog.university_order(), 50, 10)
    site = catalog.known_site(F.col("candidate_school_id"), F.col("official_site"), {7: "https://example.org/7"})
    return rows.select("id", "university_name", "coverage_priority", site.alias("official_site"), "total", "has_more")


@query(
    "majors_page", "F2 J2 J3 L3",
    with_views(
        "majors universities departments plans",
        """SELECT *, 40 < total AS has_more FROM (SELECT m.id, u.university_name, d.department_name, m.major_code, m.major_name, count(*) OVER () AS total,
            u.candidate_school_id FROM majors m JOIN universities u ON u.id = m.university_id JOIN departments d ON d.id = m.department_id
          WHERE m.id IN (SELECT major_id FROM plans WHERE year = 1998) AND m.degree_type = 'academic'
            AND (contains(m.major_name, 'ring') OR contains(m.research_direction, 'ring'))
          ORDER BY u.candidate_school_id, d.department_name, m.major_code, m.id LIMIT 30 OFFSET 10)""",
    ),
)
def majors_page(v: Views) -> DataFrame:
    found = catalog.filter_majors(v.majors, degree_type="academic", keyword="ring")
    rows = catalog.major_list(found, v.universities, v.departments, v.plans, 1998)
    order = [F.col("candidate_school_id"), F.col("department_name"), F.col("major_code"), F.col("id")]
    return catalog.page(rows, order, 30, 10).select(
        "id", "university_name", "department_name", "major_code", "major_name", "candidate_school_id", "total", "has_more"
    )


@query(
    "majors_with_plan", "J3",
    with_views(
        "majors universities departments plans",
        """SELECT u.province, count(DISTINCT m.id) AS major_count FROM majors m JOIN universities u ON u.id = m.university_id
        JOIN departments d ON d.id = m.department_id JOIN plans p ON p.major_id = m.id WHERE p.year = 1999 GROUP BY 1""",
    ),
)
def majors_with_plan(v: Views) -> DataFrame:
    rows = catalog.major_list(v.majors, v.universities, v.departments, v.plans, 1999)
    u = v.universities.select(F.col("id").alias("university_id"), "province")
    return rows.join(u, "university_id").groupBy("province").agg(F.count(F.lit(1)).alias("major_count"))


def source_documents(v: Views) -> DataFrame:
    """Documents as sources of the university with the number in their source name."""
    return v.table("documents").select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 10).cast("bigint").alias("university_id"),
        F.when(F.col("doc_id") % 5 != 0, (F.lit(1995) + F.col("doc_id") % 7).cast("int")).alias("year"),
        F.when(F.col("lang") == "en", "plan").when(F.col("lang") == "fr", "school_list").otherwise("notice").alias("document_type"),
        F.concat(F.lit("document "), F.col("doc_id")).alias("document_title"), F.lit(None).cast("string").alias("source_url"),
        F.concat(F.lit("/docs/"), F.col("doc_id")).alias("local_path"), "text", "n_chars",
    )


SOURCES = """sources AS (SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS university_id,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(1995 + doc_id % 7 AS INTEGER) END AS year,
  CASE lang WHEN 'en' THEN 'plan' WHEN 'fr' THEN 'school_list' ELSE 'notice' END AS document_type,
  'document ' || doc_id AS document_title, text, n_chars FROM documents)"""


@query(
    "sources_page", "F3 J4 L3 C43",
    with_views(
        "universities",
        """SELECT *, 50 < total AS has_more FROM (SELECT s.id, u.university_name, s.year, s.document_type, s.document_title,
            count(*) OVER () AS total FROM sources s JOIN universities u ON u.id = s.university_id
          WHERE s.document_type = 'plan' ORDER BY s.year DESC NULLS LAST, s.id DESC LIMIT 50)""",
        SOURCES,
    ),
)
def sources_page(v: Views) -> DataFrame:
    rows = catalog.source_list(catalog.filter_sources(source_documents(v), document_type="plan"), v.universities)
    out = catalog.page(rows, [F.col("year").desc_nulls_last(), F.col("id").desc()])
    return output_types(out.select("id", "university_name", "year", "document_type", "document_title", "total", "has_more"))


@query(
    "score_lookup", "F6",
    with_views(
        "score_lines",
        """SELECT id, year, line_type, major_category, total_score_line FROM score_lines WHERE university_id = 3 AND line_type = 'major'
        ORDER BY year DESC, id LIMIT 100""",
    ),
)
def score_lookup(v: Views) -> DataFrame:
    rows = catalog.score_line_lookup(v.score_lines, university_id=3, line_type="major", limit=100)
    return rows.select("id", "year", "line_type", "major_category", "total_score_line")


@query(
    "national_of_year", "F6",
    with_views("score_lines", "SELECT id, major_category, total_score_line, politics_line FROM score_lines WHERE line_type = 'national' AND year = 1997"),
)
def national_of_year(v: Views) -> DataFrame:
    return catalog.national_lines_of(v.score_lines, 1997).select("id", "major_category", "total_score_line", "politics_line")


@query(
    "major_search", "F5 F11",
    with_views(
        "majors",
        """SELECT id, major_code, major_name, major_category FROM majors WHERE (contains(major_name, 'bolt') OR contains(major_code, 'bolt'))
        AND major_category = 'SMALL' AND degree_type = 'professional'""",
    ),
)
def major_search(v: Views) -> DataFrame:
    found = catalog.filter_majors(
        v.majors, keyword="bolt", keyword_columns=("major_name", "major_code"), major_category="SMALL", degree_type="professional"
    )
    return found.select("id", "major_code", "major_name", "major_category")


@query(
    "university_search", "F4 F13",
    with_views(
        "universities",
        """SELECT id, university_name AS name, province, city, school_type AS type, school_level AS level FROM universities
        WHERE school_type = '理工' AND contains(school_level, '211')""",
    ),
)
def university_search(v: Views) -> DataFrame:
    return catalog.university_brief(catalog.filter_universities(v.universities, school_type="理工", level="211"))


@query(
    "rating_search", "F12",
    with_views("rates", "SELECT id, university_id, subject_code, level_rate FROM rates WHERE contains(subject_name, 'widget')"),
)
def rating_search(v: Views) -> DataFrame:
    return catalog.ratings(v.rates, subject_name="widget").select("id", "university_id", "subject_code", "level_rate")


@query(
    "department_list", "F11",
    with_views("departments", "SELECT id, university_id, department_name FROM departments WHERE university_id = 5"),
)
def department_list(v: Views) -> DataFrame:
    return catalog.departments_of(v.departments, 5)


@query(
    "major_options", "A7",
    with_views(
        "plans majors universities",
        """SELECT m.major_code, m.major_name, m.major_category, CAST(sum(p.plan_count) AS BIGINT) AS total_plan,
          count(DISTINCT p.year) AS year_count, count(DISTINCT p.major_id) AS major_count
        FROM plans p JOIN majors m ON m.id = p.major_id JOIN universities u ON u.id = p.university_id GROUP BY 1, 2, 3""",
    ),
)
def major_options(v: Views) -> DataFrame:
    return catalog.major_options(v.plans, v.majors, v.universities, limit=None)


@query(
    "line_options", "A8",
    with_views(
        "score_lines",
        """SELECT university_id, major_category AS score_line_major_name, count(DISTINCT year) AS year_count, min(year) AS min_year,
          max(year) AS max_year, count(*) AS score_line_count
        FROM score_lines WHERE line_type = 'major' AND total_score_line > 0 GROUP BY 1, 2""",
    ),
)
def line_options(v: Views) -> DataFrame:
    return catalog.line_options(v.score_lines)


@query(
    "name_search", "A9 L6",
    with_views(
        "plans majors",
        """SELECT m.major_name, m.major_code, m.major_category, count(DISTINCT m.university_id) AS match_count,
          CAST(sum(coalesce(p.plan_count, 0)) AS BIGINT) AS total_plan
        FROM majors m LEFT JOIN plans p ON p.major_id = m.id WHERE contains(m.major_name, 'plate')
        GROUP BY 1, 2, 3 ORDER BY 5 DESC, 4 DESC, strlen(m.major_name), 1, 2, 3 LIMIT 12""",
    ),
)
def name_search(v: Views) -> DataFrame:
    return catalog.major_name_search(v.majors, v.plans, "plate", 12)


@query(
    "category_union_search", "U1 F9",
    with_views(
        "majors score_lines",
        """SELECT major_category FROM (SELECT major_category FROM majors UNION SELECT major_category FROM score_lines
          WHERE line_type IN ('major', 'national')) WHERE contains(major_category, 'r') ORDER BY strlen(major_category), major_category LIMIT 50""",
    ),
)
def category_union_search(v: Views) -> DataFrame:
    return catalog.category_search(v.majors, v.score_lines, "r", 50, readable=False)


@query(
    "category_distincts", "U2",
    with_views(
        "majors score_lines",
        """SELECT DISTINCT 'majors' AS source, major_category FROM majors
        UNION ALL SELECT DISTINCT 'score_lines', major_category FROM score_lines WHERE line_type = 'major'
        UNION ALL SELECT DISTINCT 'national_lines', major_category FROM score_lines WHERE line_type = 'national'
        UNION ALL SELECT 'combined', major_category FROM (SELECT major_category FROM majors UNION SELECT major_category FROM score_lines
          WHERE line_type IN ('major', 'national'))""",
    ),
)
def category_distincts(v: Views) -> DataFrame:
    return catalog.categories_by_source(v.majors, v.score_lines, readable=False)


@query(
    "distinct_levels", "U3",
    with_views("universities", "SELECT DISTINCT school_level FROM universities WHERE province_area = 'ASIA'"),
)
def distinct_levels(v: Views) -> DataFrame:
    return catalog.distinct_values(v.universities, "school_level", {"province_area": "ASIA"})


@query(
    "health_counts", "A10",
    with_views(
        "universities majors departments plans score_lines",
        """SELECT (SELECT count(*) FROM universities) AS universities, (SELECT count(*) FROM majors) AS majors,
          (SELECT count(*) FROM departments) AS departments, (SELECT count(*) FROM plans) AS enrollment_plans,
          (SELECT count(*) FROM score_lines) AS score_lines, (SELECT count(*) FROM documents) AS source_documents,
          (SELECT min(year) FROM plans) AS min_year, (SELECT max(year) FROM plans) AS max_year,
          (SELECT count(DISTINCT year) FROM plans) AS year_count""",
    ),
)
def health_counts(v: Views) -> DataFrame:
    tables = {
        "universities": v.universities, "majors": v.majors, "departments": v.departments, "enrollment_plans": v.plans,
        "score_lines": v.score_lines, "source_documents": v.table("documents"),
    }
    return catalog.health_counts(v.spark, tables, v.plans)


@query(
    "university_profiles", "A22 F13",
    with_views(
        "universities departments majors score_lines rates",
        """SELECT u.id AS university_id, u.university_name, d.n AS department_count, m.n AS major_count, r.t AS ratings, l.t AS lines
        FROM universities u
        LEFT JOIN (SELECT university_id, count(*) AS n FROM departments GROUP BY 1) d ON d.university_id = u.id
        LEFT JOIN (SELECT university_id, count(*) AS n FROM majors GROUP BY 1) m ON m.university_id = u.id
        LEFT JOIN (SELECT university_id, string_agg(subject_name || '(' || level_rate || ')', ', ' ORDER BY id) AS t FROM
          (SELECT *, row_number() OVER (PARTITION BY university_id ORDER BY id) AS k FROM rates WHERE level_rate IS NOT NULL)
          WHERE k <= 5 GROUP BY 1) r ON r.university_id = u.id
        LEFT JOIN (SELECT university_id, string_agg(year || ':' || total_score_line, ', ' ORDER BY k) AS t FROM
          (SELECT *, row_number() OVER (PARTITION BY university_id ORDER BY year DESC, total_score_line DESC, id) AS k FROM score_lines)
          WHERE k <= 3 AND university_id IS NOT NULL GROUP BY 1) l ON l.university_id = u.id""",
    ),
)
def university_profiles(v: Views) -> DataFrame:
    lines = v.score_lines.filter(F.col("university_id").isNotNull())
    p = catalog.university_profiles(v.universities, v.departments, v.majors, lines, v.rates)
    rated = F.transform("ratings", lambda r: F.concat(r["subject_name"], F.lit("("), r["level_rate"], F.lit(")")))
    lined = F.transform("lines", lambda x: F.concat_ws(":", x["year"].cast("string"), x["total_score_line"].cast("string")))
    return p.select(
        "university_id", "university_name", "department_count", "major_count", F.array_join(rated, ", ").alias("ratings"),
        F.array_join(lined, ", ").alias("lines"),
    )


@query(
    "profile_rows", "A22",
    with_views(
        "departments rates",
        """SELECT university_id, 'departments' AS part, department_name AS value FROM departments
        UNION ALL SELECT university_id, 'ratings', subject_code FROM rates WHERE level_rate IS NOT NULL""",
    ),
)
def profile_rows(v: Views) -> DataFrame:
    parts = {"departments": v.departments, "ratings": v.rates.filter(F.col("level_rate").isNotNull())}
    rows = catalog.profile_rows("university_id", parts)
    value = F.coalesce(F.get_json_object("record", "$.department_name"), F.get_json_object("record", "$.subject_code"))
    return rows.select("university_id", "part", value.alias("value"))


@query(
    "schools_with_major", "J18",
    with_views(
        "universities majors",
        """SELECT id, university_name, school_level FROM universities WHERE contains(school_level, '双一流')
          AND id IN (SELECT university_id FROM majors WHERE major_category = 'LARGE') ORDER BY id LIMIT 20""",
    ),
)
def schools_with_major(v: Views) -> DataFrame:
    found = catalog.schools_with_major(v.universities, v.majors, major_category="LARGE", school_level="双一流", limit=20)
    return found.select("id", "university_name", "school_level")


@query(
    "matching_majors", "A23",
    with_views(
        "universities majors",
        """SELECT u.id AS university_id, m.major_code, m.major_name FROM universities u JOIN majors m ON m.university_id = u.id
        WHERE m.major_category = 'LARGE'""",
    ),
)
def matching_majors(v: Views) -> DataFrame:
    return catalog.matching_majors(v.universities, v.majors, "LARGE")


@query(
    "matching_schools", "A23",
    with_views(
        "universities majors rates",
        """SELECT u.id, u.university_name AS name, u.province, u.school_type AS type, u.school_level AS level, coalesce(m.majors, '') AS matching_majors, coalesce(r.ratings, '') AS subject_ratings
        FROM universities u LEFT JOIN (SELECT university_id, string_agg(major_code || ':' || major_name, ',' ORDER BY id) AS majors FROM majors WHERE major_category = 'LARGE' GROUP BY 1) m ON m.university_id = u.id
        LEFT JOIN (SELECT university_id, string_agg(subject_name || ':' || level_rate, ',' ORDER BY id) AS ratings FROM rates WHERE level_rate <> '' GROUP BY 1) r ON r.university_id = u.id""",
    ),
)
def matching_schools(v: Views) -> DataFrame:
    """Nested lists, written as text for the comparison."""
    out = catalog.matching_schools(v.universities, v.majors, v.rates, "LARGE")
    listed = lambda name, a, b: F.array_join(F.transform(name, lambda r: F.concat(r[a], F.lit(":"), r[b])), ",").alias(name)
    return out.select("id", "name", "province", "type", "level", listed("matching_majors", "code", "name"), listed("subject_ratings", "subject", "level"))


@query(
    "majors_deep_page", "L3 F2 J2",
    with_views("majors", """SELECT id, (SELECT count(*) FROM majors) AS total FROM majors ORDER BY id DESC LIMIT 200 OFFSET 12000"""),
)
def majors_deep_page(v: Views) -> DataFrame:
    """A page far behind the first one."""
    return catalog.page(v.majors, [F.col("id").desc()], 200, 12000).select("id", "total")


@query(
    "level_options", "F8",
    with_views("universities", "SELECT id FROM universities WHERE contains(school_level, '985') OR contains(school_level, '普通')"),
)
def level_options(v: Views) -> DataFrame:
    return v.universities.filter(any_contains(F.col("school_level"), ["985", "普通"])).select("id")
