"""Lists, searches, option lists and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitlens.functions.codes import enum_rank, literal_map
from admitlens.functions.text import readable_category, strip
from admitlens.operators.keyed import numbered_in, top_n
from admitlens.plans.charts import UNCLASSIFIED
from admitlens.rules import OFFICIAL_SITES, PRIORITIES

DEFAULT_LIMIT = 50
MAX_LIMIT = 200


# --- filters ---------------------------------------------------------------------------------


def optional_filters(
    equal: dict[str, object] | None = None, contains: dict[str | tuple[str, ...], str | None] | None = None
) -> Column:
    """AND of the filters that have a value. A tuple of columns means one of them contains the text.

    `contains` is literal: % and _ have no special meaning.
    """
    parts = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v not in (None, "")]
    for columns, text in (contains or {}).items():
        if text:
            names = columns if isinstance(columns, tuple) else (columns,)
            hits = [F.coalesce(F.col(c).contains(text), F.lit(False)) for c in names]
            parts.append(reduce(lambda a, b: a | b, hits))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_universities(
    df: DataFrame, coverage_priority: str | None = None, official_verified_status: str | None = None,
    school_type: str | None = None, school_org_type: str | None = None, keyword: str | None = None,
    province: str | None = None, level: str | None = None,
) -> DataFrame:
    return df.filter(
        optional_filters(
            {
                "coverage_priority": coverage_priority, "official_verified_status": official_verified_status,
                "school_type": school_type, "school_org_type": school_org_type, "province": province,
            },
            {"university_name": keyword, "school_level": level},
        )
    )


def filter_majors(
    df: DataFrame, university_id: int | None = None, school_id: int | None = None, major_category: str | None = None,
    degree_type: str | None = None, study_mode: str | None = None, major_code: str | None = None,
    department_id: int | None = None, keyword: str | None = None,
    keyword_columns: tuple[str, ...] = ("major_name", "research_direction"),
) -> DataFrame:
    return df.filter(
        optional_filters(
            {
                "university_id": university_id, "candidate_school_id": school_id, "major_category": major_category,
                "degree_type": degree_type, "study_mode": study_mode, "major_code": major_code,
                "department_id": department_id,
            },
            {keyword_columns: keyword},
        )
    )


def filter_sources(
    df: DataFrame, university_id: int | None = None, school_id: int | None = None, year: int | None = None,
    document_type: str | None = None, process_status: str | None = None,
) -> DataFrame:
    return df.filter(
        optional_filters(
            {
                "university_id": university_id, "candidate_school_id": school_id, "year": year,
                "document_type": document_type, "process_status": process_status,
            }
        )
    )


def score_line_lookup(
    lines: DataFrame, university_id: int | None = None, major_id: int | None = None, year: int | None = None,
    line_type: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Lines by any of four keys, newest first."""
    found = lines.filter(
        optional_filters({"university_id": university_id, "major_id": major_id, "year": year, "line_type": line_type})
    ).orderBy(F.desc("year"), "id")
    return found if limit is None else found.limit(limit)


def national_lines_of(lines: DataFrame, year: int) -> DataFrame:
    return lines.filter((F.col("line_type") == "national") & (F.col("year") == year))


def ratings(rates: DataFrame, university_id: int | None = None, subject_name: str | None = None) -> DataFrame:
    return rates.filter(optional_filters({"university_id": university_id}, {"subject_name": subject_name}))


def departments_of(departments: DataFrame, university_id: int) -> DataFrame:
    return departments.filter(F.col("university_id") == university_id)


def university_brief(universities: DataFrame, university_id: int | None = None) -> DataFrame:
    return universities.filter(optional_filters({"id": university_id})).select(
        "id", F.col("university_name").alias("name"), "province", "city", F.col("school_type").alias("type"),
        F.col("school_level").alias("level"),
    )


# --- lists and pages -------------------------------------------------------------------------


def known_site(school_id: Column, stored: Column, sites: dict[int, str] | None = None) -> Column:
    """A known site of the school, else the stored one."""
    table = OFFICIAL_SITES if sites is None else sites
    if not table:
        return stored
    return F.coalesce(F.try_element_at(literal_map({str(k): v for k, v in table.items()}), school_id.cast("string")), stored)


def university_order(priorities: Sequence[str] = tuple(PRIORITIES)) -> list[Column]:
    return [enum_rank(F.col("coverage_priority"), list(priorities)), F.col("candidate_school_id"), F.col("id")]


def major_list(
    majors: DataFrame, universities: DataFrame, departments: DataFrame, plans: DataFrame | None = None, year: int | None = None
) -> DataFrame:
    """Majors with school and department names; with a year only majors that have a plan in it."""
    u = universities.select(F.col("id").alias("university_id"), "candidate_school_id", "university_name")
    d = departments.select(F.col("id").alias("department_id"), "department_name")
    out = majors.join(u, "university_id").join(d, "department_id")
    if year is not None:
        wanted = plans.filter(F.col("year") == year).select(F.col("major_id").alias("_m"))
        out = out.join(wanted, F.col("id") == F.col("_m"), "left_semi")
    return out


def source_list(documents: DataFrame, universities: DataFrame) -> DataFrame:
    u = universities.select(F.col("id").alias("university_id"), "candidate_school_id", "university_name")
    return documents.join(u, "university_id")


def page_bounds(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    """Checked page size and offset: default 50 rows; more than 200 are refused."""
    size, start = int(limit or DEFAULT_LIMIT), int(offset or 0)
    if not 0 < size <= MAX_LIMIT or start < 0:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT} and offset not negative")
    return size, start


SHALLOW = 10_000  # rows before a page that Spark may keep while it looks for the first ones


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page with the columns `total` and `has_more`.

    `orderBy.offset.limit` keeps all rows before the page in one task. Deep pages take the rows with the wanted numbers from ranges of the
    order instead, of which each knows how many rows come before it.
    """
    size, start = page_bounds(limit, offset)
    total = df.agg(F.count(F.lit(1))).scalar()
    if start <= SHALLOW:
        rows = df.orderBy(*order).offset(start).limit(size)
    else:
        rows = numbered_in(df, order, "_place", 0).filter(F.col("_place").between(start, start + size - 1)).drop("_place")
    return rows.withColumn("total", total).withColumn("has_more", F.lit(start + size) < F.col("total"))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The newest rows of every key, for example the last 50 runs of each user."""
    return top_n(df, keys, order, limit, rank="position")


# --- options and searches --------------------------------------------------------------------


def major_options(
    plans: DataFrame, majors: DataFrame, universities: DataFrame, major_category: str | None = None,
    school_id: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Majors that have plans, largest first; categories without a name share one label."""
    named = (F.col("major_code") != "") & (F.col("major_name") != "")
    m = majors.filter(named & optional_filters({"major_category": major_category})).select(
        F.col("id").alias("major_id"), "major_code", "major_name",
        F.coalesce(F.when(F.col("major_category") != "", F.col("major_category")), F.lit(UNCLASSIFIED)).alias("major_category"),
    )
    u = universities.filter(optional_filters({"candidate_school_id": school_id})).select(F.col("id").alias("university_id"))
    joined = plans.filter(F.col("plan_count").isNotNull()).join(m, "major_id").join(u, "university_id", "left_semi")
    grouped = joined.groupBy("major_code", "major_name", "major_category").agg(
        F.sum("plan_count").alias("total_plan"), F.count_distinct("year").alias("year_count"),
        F.count_distinct("major_id").alias("major_count"),
    )
    return _limited(grouped, [F.desc("total_plan"), F.desc("major_count"), "major_code", "major_name"], limit)


def line_options(lines: DataFrame, by: Sequence[str] = ("university_id",), limit: int | None = None) -> DataFrame:
    """Line names of each school with their years and counts."""
    used = lines.filter((F.col("line_type") == "major") & (F.col("total_score_line") > 0) & (F.col("major_category") != ""))
    grouped = used.groupBy(*by, F.col("major_category").alias("score_line_major_name")).agg(
        F.count_distinct("year").alias("year_count"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.count(F.lit(1)).alias("score_line_count"),
    )
    return _limited(grouped, [*by, "score_line_major_name"], limit)


def major_name_search(
    majors: DataFrame, plans: DataFrame, keyword: str, limit: int | None = None, major_category: str | None = None,
    degree_type: str | None = None, study_mode: str | None = None, target_year: int | None = None,
) -> DataFrame:
    """Majors whose name contains the keyword, with the number of schools and the planned places."""
    keep = optional_filters(
        {"degree_type": degree_type, "study_mode": study_mode},
        {"major_name": keyword.strip(), ("major_category", "major_name"): major_category},
    )
    m = majors.filter(keep & (F.col("major_name") != ""))
    label = F.coalesce(F.when(F.col("major_category") != "", F.col("major_category")), F.lit(UNCLASSIFIED))
    p = plans if target_year is None else plans.filter(F.col("year") == target_year)
    per_major = p.groupBy("major_id").agg(F.sum(F.coalesce("plan_count", F.lit(0))).alias("_plan"))
    joined = m.join(per_major, F.col("id") == F.col("major_id"), "left" if target_year is None else "inner")
    grouped = joined.groupBy("major_name", "major_code", label.alias("major_category")).agg(
        F.count_distinct("university_id").alias("match_count"), F.sum(F.coalesce("_plan", F.lit(0))).alias("total_plan")
    )
    order = [F.desc("total_plan"), F.desc("match_count"), F.octet_length("major_name"), "major_name", "major_code", "major_category"]
    return _limited(grouped, order, limit)


def category_search(majors: DataFrame, lines: DataFrame, keyword: str, limit: int | None = None, readable: bool = True) -> DataFrame:
    """Category names of majors, major lines and national lines that contain the keyword, shortest first."""
    hit = F.col("major_category").contains(keyword.strip()) & (F.col("major_category") != "")
    both = majors.select("major_category").unionByName(
        lines.filter(F.col("line_type").isin("major", "national")).select("major_category")
    )
    found = both.filter(hit).distinct()
    cut = _limited(found, [F.octet_length("major_category"), "major_category"], limit)
    kept = cut.filter(readable_category(F.col("major_category"))) if readable else cut
    return kept.select(strip(F.col("major_category")).alias("major_category"))


def categories_by_source(majors: DataFrame, lines: DataFrame, readable: bool = True) -> DataFrame:
    """Distinct trimmed categories per source, and of all sources together."""
    parts = {
        "majors": majors.select("major_category"),
        "score_lines": lines.filter(F.col("line_type") == "major").select("major_category"),
        "national_lines": lines.filter(F.col("line_type") == "national").select("major_category"),
    }
    tagged = [df.distinct().select(F.lit(name).alias("source"), "major_category") for name, df in parts.items()]
    rows = reduce(DataFrame.unionByName, tagged).filter(F.col("major_category") != "")
    if readable:
        rows = rows.filter(readable_category(F.col("major_category")))
    rows = rows.withColumn("major_category", strip(F.col("major_category"))).distinct()
    combined = rows.select(F.lit("combined").alias("source"), "major_category").distinct()
    return rows.unionByName(combined)


def distinct_values(df: DataFrame, column: str, equal: dict[str, object] | None = None) -> DataFrame:
    return df.filter(optional_filters(equal) & (F.col(column) != "")).select(column).distinct()


def _limited(df: DataFrame, order: Sequence[Column | str], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


# --- counts ----------------------------------------------------------------------------------


def health_counts(spark: SparkSession, tables: dict[str, DataFrame], plans: DataFrame) -> DataFrame:
    """One row: the size of every table and the range of plan years."""
    n = F.count(F.lit(1))
    years = plans.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_distinct("year").alias("year_count"))
    return years.withColumns({name: df.agg(n).scalar() for name, df in tables.items()})


def user_activity(logs: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user: runs, schools returned, year of the newest run and the most frequent major.

    Majors are counted before they are compared, so a busy user is never gathered in one task.
    """
    per_major = logs.groupBy(user, "major_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("returned_count").alias("returned"),
        F.max(F.struct("created_at", "id")).alias("newest"),
        F.max_by("target_year", F.struct("created_at", "id")).alias("year"),
    )
    best = F.min_by("major_name", F.struct((-F.col("n")).alias("n"), "major_name"))
    return per_major.groupBy(user).agg(
        F.sum("n").alias("run_count"), F.sum("returned").alias("returned_total"),
        F.max_by("year", "newest").alias("latest_year"), best.alias("top_major"),
    )


# --- profiles --------------------------------------------------------------------------------


def university_profiles(
    universities: DataFrame, departments: DataFrame, majors: DataFrame, lines: DataFrame, rates: DataFrame,
    first_rates: int = 5, newest_lines: int = 3,
) -> DataFrame:
    """Brief profiles: counts, the first ratings and the newest lines of each university."""

    def count_of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("university_id").agg(F.count(F.lit(1)).alias(name))

    r = top_n(rates.filter(F.col("level_rate").isNotNull()), ["university_id"], [F.col("id")], first_rates)
    r = r.groupBy("university_id").agg(F.sort_array(F.collect_list(F.struct("id", "subject_name", "level_rate"))).alias("ratings"))
    newest = [F.desc("year"), F.desc("total_score_line"), F.col("id")]
    s = top_n(lines, ["university_id"], newest, newest_lines, rank="_pos")
    s = s.groupBy("university_id").agg(F.sort_array(F.collect_list(F.struct("_pos", "year", "total_score_line"))).alias("lines"))
    out = universities.select(F.col("id").alias("university_id"), "university_name", "province", "school_type", "school_level")
    for side in (count_of(departments, "department_count"), count_of(majors, "major_count"), r, s):
        out = out.join(side, "university_id", "left")
    return out


def profile_rows(university_id_column: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Complete profiles as rows (university, part, JSON of one record): nothing is gathered per school."""
    rows = [
        df.select(F.col(university_id_column), F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("record"))
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def schools_with_major(
    universities: DataFrame, majors: DataFrame, major_category: str | None = None, province: str | None = None,
    school_type: str | None = None, school_level: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Universities that have a major of the category (all of them when none is asked for)."""
    u = universities.filter(optional_filters({"province": province, "school_type": school_type}, {"school_level": school_level}))
    if major_category:
        m = majors.filter(F.col("major_category") == major_category).select("university_id")
        u = u.join(m, F.col("id") == F.col("university_id"), "left_semi")
    return u if limit is None else u.orderBy("id").limit(limit)


def matching_majors(universities: DataFrame, majors: DataFrame, major_category: str) -> DataFrame:
    """(university, major code, major name) rows of the category."""
    m = majors.filter(F.col("major_category") == major_category).select("university_id", "major_code", "major_name")
    return universities.select(F.col("id").alias("university_id")).join(m, "university_id")


def matching_schools(universities: DataFrame, majors: DataFrame, rates: DataFrame, major_category: str | None = None) -> DataFrame:
    """Schools with the nested lists `matching_majors` (code, name), with a category, and `subject_ratings` (subject, level), without null levels.

    Lists are per school and empty where there is nothing; they are in the order of the tables' ids.
    """
    def nested(df: DataFrame, listed: str, /, **fields: str) -> DataFrame:
        row = F.struct("id", *[F.col(c).alias(f) for f, c in fields.items()])
        lists = df.groupBy("university_id").agg(F.sort_array(F.collect_list(row)).alias("_list"))
        return lists.select(F.col("university_id").alias("id"), F.transform("_list", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(listed))

    out = universities.select("id", F.col("university_name").alias("name"), "province", "city", F.col("school_type").alias("type"), F.col("school_level").alias("level"))
    parts = [nested(rates.filter(F.col("level_rate") != ""), "subject_ratings", subject="subject_name", level="level_rate")]
    if major_category is not None:
        parts.insert(0, nested(majors.filter(F.col("major_category") == major_category), "matching_majors", code="major_code", name="major_name"))
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out
