"""Raw collections -> one wide row per plan and research direction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens import schemas
from admitlens.functions.codes import (
    category_code,
    degree_type_std,
    province_area,
    research_areas,
    school_level,
    source_line_type,
    study_mode_std,
)
from admitlens.functions.text import clean_html, missing_to_null, strip_or_null
from admitlens.operators.bloom import bloom_of, may_have
from admitlens.operators.joins import first_code_match, unique_match
from admitlens.operators.keyed import consecutive_ids, null_safe_join, surplus_count, top_n
from admitlens.sources.stage import staged

DIRECTION_KEY = ["_school_key", "year", "plan_id", "_area_key", "exam_subject_clean"]

# The raw columns behind the integrated ones; `columns` decides which of them are carried along.
OF_SCORE = {
    "score_data_type": "data_type", "score_line_type": "data_type", "score_depart_id": "depart_id", "score_depart_name": "depart_name",
    "score_code": "code", "score_name": "name", "score_degree_type": "degree_type", "score_total": "total", "score_politics": "politics",
    "score_english": "english", "score_special_one": "special_one", "score_special_two": "special_two",
    "score_diff_to_national": "diff_total", "score_diff_politics": "diff_politics", "score_diff_english": "diff_english",
    "score_note": "note", "score_special_remark": "special_remark",
}
# Columns of a plan that decide joins and directions are always carried, others for the integrated column of their name and those named here.
OF_PLAN = {"recruit_type_name": ["study_mode_std"], "degree_type_name": ["degree_type_std"], "remark": ["plan_remark"]}
PLAN_KEYS = ["school_id", "year", "plan_id", "depart_id", "special_code", "degree_type", "level1_code", "level2_code", "recruit_number"]
LEVEL_FLAGS = ["is_985", "is_211", "syl", "is_zihuaxian"]
OF_SCHOOL = {
    **{c: [c] for c in ("school_id", "school_name", "province_name", "province_area", "type_name", "type_school_name", *LEVEL_FLAGS, "rk_rank")},
    "school_level": LEVEL_FLAGS, "school_recruit_number_reference": ["recruit_number"], "school_major_number_reference": ["major_number"],
}


def first_records(df: DataFrame, collection: str, line: str) -> DataFrame:
    """Raw records without repeats; the first record of a key stays."""
    return top_n(df, schemas.RAW_KEYS[collection], [F.col(line)])


def block_counts(df: DataFrame, status: str, collection: str) -> DataFrame:
    """Counters of one raw collection: records, successes, errors, repeats."""
    counts = df.agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col(status) == "success").alias("success_count"),
        F.count_if(F.col(status) == "error").alias("error_count"),
    )
    repeats = surplus_count(df, schemas.RAW_KEYS[collection]).scalar()
    return counts.withColumn("duplicate_count", repeats)


def _first_set(*cols: Column) -> Column:
    return F.coalesce(*[missing_to_null(c) for c in cols])


def _first_number(*cols: Column) -> Column:
    """First value that is neither missing nor zero."""
    return F.coalesce(*[F.when(~c.isin("", "0"), c) for c in cols])


def expand_directions(plans: DataFrame, details: DataFrame, line: str) -> DataFrame:
    """Plans with their detail and one row per research direction (a default one when there is none)."""
    d = details.select(
        F.col("plan_id").alias("_d_plan"), F.col("source_status").alias("_status"),
        F.col("error_message").alias("_error"), F.col("data").alias("d"),
    )
    joined = plans.join(d, F.col("plan_id") == F.col("_d_plan"), "left").drop("_d_plan")
    year, default = strip_or_null(F.col("year")), strip_or_null(F.col("d.default_year"))
    areas = research_areas(F.col("d.research_area_data"), year, default)
    rows = joined.select("*", F.posexplode_outer(areas).alias("_area_pos", "a"))
    plain = F.col("a").isNull()
    return (
        rows.withColumn("_area_pos", F.coalesce("_area_pos", F.lit(0)))
        .withColumn("_area_recruit", F.when(plain, _first_number(F.col("recruit_number"), F.col("d.recruit_number"))).otherwise(F.col("a.recruit_number")))
        .withColumn("_area_key", strip_or_null(F.col("a.research_area")))
        .withColumn("exam_subject_clean", clean_html(F.col("a.exam_subject")))
        .withColumn("_school_key", F.col("school_id"))
        .withColumn("d", F.col("d").dropFields("research_area_data", "default_year"))
    )


def integrate(
    schools: DataFrame,
    plans: DataFrame,
    details: DataFrame,
    scores: DataFrame,
    levels: DataFrame,
    batch: str,
    line: str = "_line",
    source_api: str = "plan_list+plan_detail",
    default_province: str = "重庆",
    city: str = "重庆市",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Integrated rows with `_line_no`: all columns, or those of `columns`. Plans, scores and levels carry their input position in `line`.

    Details and directions come first, then levels, scores and the schools, of which there are few, so that what they bring is not carried
    through the shuffles before. Rows are staged between shuffles, so that the files of one are gone before the next.
    """
    held = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(staged(df))
        return held[-1]

    made = schemas.INTEGRATED if columns is None else columns
    read_scores = {OF_SCORE[c] for c in made if c in OF_SCORE} or {"data_type"}
    read_schools = {x for c in made for x in OF_SCHOOL.get(c, [])} or {"school_id"}

    def either(name: str) -> Column:
        return _first_set(F.col(f"d.{name}"), F.col(name))

    score_key = {"year": "_s_year", "depart_id": "_s_depart", "special_code": "_s_code", "degree_type": "_s_degree"}
    own = {c: strip_or_null(F.col(c)) for c in score_key}
    read_plans = [c for c in plans.columns if c in (*PLAN_KEYS, *made, line) or any(x in made for x in OF_PLAN.get(c, []))]
    score_side = scores.filter(F.col("data_type") == "school_score").select(
        strip_or_null(F.col("school_id")).alias("_s_school"),
        strip_or_null(F.col("year")).alias("_s_year"),
        strip_or_null(F.col("depart_id")).alias("_s_depart"),
        strip_or_null(F.col("code")).alias("_s_code"),
        strip_or_null(F.col("degree_type")).alias("_s_degree"),
        F.struct(*[c for c in schemas.RAW["scores"] if c in read_scores]).alias("s"),
    )
    expanded = expand_directions(plans.select(*read_plans), details, line)
    directions = top_n(expanded, DIRECTION_KEY, [F.col(line), F.col("_area_pos")])
    directions = directions.withColumns({"_level1": strip_or_null(either("level1_code")), "_level2": strip_or_null(either("level2_code"))})
    level_side = levels.select(
        F.col("school_id").alias("_school_key"),
        strip_or_null(F.col("code")).alias("_level_code"),
        F.struct(*[c for c in schemas.RAW["levels"] if c != "school_id"]).alias("l"),
        F.col(line).alias("_level_line"),
    )
    # Records of one school id stay apart until repeated directions are gone: each gives a row.
    school_record = F.struct(*[c for c in schemas.RAW["schools"] if c in read_schools])
    # Staged, they are known to be few before the rows are shuffled for them.
    listed = keep(schools.select(F.col("school_id").alias("_school_key"), school_record.alias("_school")))
    school_side = listed.groupBy("_school_key").agg(F.collect_list("_school").alias("_schools"))

    special = strip_or_null(either("special_code"))
    recruit_name = either("recruit_type_name")
    degree_name = either("degree_type_name")
    values = {
        "source_status": F.coalesce(missing_to_null(F.col("_status")), F.lit("missing")),
        "error_message": F.col("_error"),
        "year": F.col("year"),
        "plan_id": F.col("plan_id"),
        "spe_id": _first_number(F.col("spe_id"), F.col("d.spe_id")),
        "depart_id": either("depart_id"),
        "depart_name": either("depart_name"),
        "special_code": special,
        "special_name": either("special_name"),
        "major_category_code": category_code(special),
        "level1_name": either("level1_name"),
        "level2_name": either("level2_name"),
        "degree_type": F.col("degree_type"),
        "degree_type_std": degree_type_std(_first_number(F.col("degree_type"), degree_name)),
        "degree_type_name": degree_name,
        "recruit_type": F.col("d.recruit_type"),
        "recruit_type_name": recruit_name,
        "study_mode_std": study_mode_std(recruit_name),
        "exam_class": F.col("d.exam_class"),
        "exam_class_name": either("exam_class_name"),
        "research_area": F.col("a.research_area"),
        "exam_subject": F.col("a.exam_subject"),
        "exam_subject_clean": F.col("exam_subject_clean"),
        "research_area_note": F.col("a.note"),
        "is_statistic_direction": F.col("a.is_statistic_direction"),
        "exam_book": F.col("d.exam_book"),
        "exam_book_clean": clean_html(F.col("d.exam_book")),
        "exam_book_year": F.col("d.exam_book_year"),
        "intro_id": F.col("d.intro_id"),
        "plan_recruit_number": _first_number(F.col("_area_recruit"), F.col("d.recruit_number"), F.col("recruit_number")),
        "plan_remark": F.col("remark"),
        "min_score": F.col("d.min_score"),
        "score_years_json": F.when(~F.col("d.score_years").isin("", "[]", "{}"), F.col("d.score_years")),
        "major_rate": F.col("d.major_rate"),
        "doctoral_point": F.col("d.doctoral_point"),
    }
    late = {
        "batch_id": F.lit(batch),
        "source_api": F.lit(source_api),
        "school_id": F.col("h.school_id"),
        "school_name": F.col("h.school_name"),
        "province_name": _first_set(F.col("h.province_name"), F.lit(default_province)),
        "city": F.lit(city),
        "province_area": province_area(F.col("h.province_area")),
        "type_name": F.col("h.type_name"),
        "type_school_name": F.col("h.type_school_name"),
        "is_985": F.col("h.is_985"),
        "is_211": F.col("h.is_211"),
        "syl": F.col("h.syl"),
        "is_zihuaxian": F.col("h.is_zihuaxian"),
        "school_level": school_level({f: F.col(f"h.{f}") for f in LEVEL_FLAGS}),
        "school_recruit_number_reference": F.col("h.recruit_number"),
        "school_major_number_reference": F.col("h.major_number"),
        "rk_rank": F.col("h.rk_rank"),
        "level1_code": F.col("_level1"),
        "level2_code": F.col("_level2"),
        "subject_code": F.col("l.code"),
        "subject_name": F.col("l.code_name"),
        "subject_degree_type": F.col("l.degree_type"),
        "subject_degree_type_std": degree_type_std(F.col("l.degree_type")),
        "level_rate": F.col("l.rate"),
        "rate_sort": F.col("l.rate_sort"),
        "has_doctor": F.col("l.has_doctor"),
        "score_data_type": F.col("s.data_type"),
        "score_line_type": source_line_type(F.col("s.data_type")),
        "score_depart_id": F.col("s.depart_id"),
        "score_depart_name": F.col("s.depart_name"),
        "score_code": F.col("s.code"),
        "score_name": F.col("s.name"),
        "score_degree_type": F.col("s.degree_type"),
        "score_total": F.col("s.total"),
        "score_politics": F.col("s.politics"),
        "score_english": F.col("s.english"),
        "score_special_one": F.col("s.special_one"),
        "score_special_two": F.col("s.special_two"),
        "score_diff_to_national": F.col("s.diff_total"),
        "score_diff_politics": F.col("s.diff_politics"),
        "score_diff_english": F.col("s.diff_english"),
        "score_note": F.col("s.note"),
        "score_special_remark": F.col("s.special_remark"),
    }
    found_by = ["_school_key", "_level2", "_level1"]
    # The plan's own score key is carried only where the integrated columns differ from it.
    shared = [c for c in score_key if c in made]
    same = reduce(lambda x, y: x & y, [own[c].eqNullSafe(values[c]) for c in shared], F.lit(True))
    # Most rows have no score: only those whose key may be among the scores' are shuffled for them.
    listed_scores = keep(score_side)
    known_keys = listed_scores.select(F.xxhash64("_s_school", *score_key.values()).alias("_key"))
    asking = may_have(bloom_of(known_keys, "_key"), F.xxhash64(strip_or_null(F.col("_school_key")), *own.values()))
    ready = directions.select(
        *[values[c].alias(c) for c in made if c in values], *[own[c].alias(key) for c, key in score_key.items() if c not in shared],
        F.when(~same, F.struct(F.lit(1), *[own[c].alias(c) for c in shared])).alias("_own"), asking.alias("_asking"), *found_by, F.col(line).alias("_in"), "_area_pos",
    )
    leveled = first_code_match(ready, level_side, found_by[:1], found_by[1:], "_level_code", "_level_line", keep)
    alike = F.col("_own").isNull()
    keyed = leveled.withColumns(
        {
            "_s_school": strip_or_null(F.col("_school_key")),
            **{score_key[c]: F.when(alike, F.col(c)).otherwise(F.col("_own")[c]) for c in shared},
            **{c: F.when(~alike, F.col(c)) for c in shared},
        }
    )
    others = keyed.filter(~F.col("_asking")).withColumn("s", F.lit(None).cast(listed_scores.schema["s"].dataType))
    matched = unique_match(keyed.filter("_asking"), listed_scores, ["_s_school", *score_key.values()]).unionByName(others)
    scored = matched.withColumns({c: F.when(alike, F.col(score_key[c])).otherwise(F.col(c)) for c in shared})
    known = null_safe_join(scored, school_side, ["_school_key"], "left").select("*", F.explode_outer("_schools").alias("h"))
    rows = known.select(*[late[c].alias(c) if c in late else c for c in made], "_in", "_area_pos")
    numbered = consecutive_ids(rows.withColumn("_stage", F.lit(0)), "_stage", "_in", ["_area_pos"], "_line_no", held)
    return numbered.withColumn("_line_no", F.col("_line_no") + 1).drop("_stage", "_in", "_area_pos")


COUNTS = [
    "unique_plan_count", "detail_success_count", "detail_error_count", "detail_missing_count", "plan_rows", "duplicate_count",
    "score_matched_count", "level_rate_matched_count",
]


def integration_counts(plans: DataFrame, details: DataFrame, integrated: DataFrame, line: str = "_line") -> DataFrame:
    """One row of counters: rows, repeats, detail states, matches."""
    # Every pair of a plan and its detail has one row at the first position, so one pass over the directions counts both.
    expanded = expand_directions(plans, details, line)
    state = F.when(F.col("_area_pos") == 0, F.when(F.col("_status").isin("success", "error"), F.col("_status")).otherwise("missing"))
    per_key = expanded.groupBy(*DIRECTION_KEY).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(state == x).alias(x) for x in ("success", "error", "missing")]
    )
    per_plan = per_key.agg(
        F.count_distinct("plan_id").alias("unique_plan_count"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(f"detail_{x}_count") for x in ("success", "error", "missing")],
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    )

    def over_rows(value: Column) -> Column:
        return integrated.agg(value).scalar()

    return per_plan.withColumns(
        {
            "plan_rows": over_rows(F.count(F.lit(1))),
            "score_matched_count": over_rows(F.count("score_data_type")),
            "level_rate_matched_count": over_rows(F.count("subject_code")),
        }
    ).select(*COUNTS)


#: What `integration_counts` reads of the integrated rows.
COUNTED = ["score_data_type", "subject_code"]


def rows_per_school_year(integrated: DataFrame, years: list[str] | None = None) -> DataFrame:
    """Rows per school and year; with given years one column per year."""
    known = integrated.filter((F.col("school_id").cast("string") != "") & (F.col("year").cast("string") != ""))
    if years is None:
        return known.groupBy("school_id", "year").agg(F.count(F.lit(1)).alias("plan_rows"))
    return known.groupBy("school_id").pivot("year", years).agg(F.count(F.lit(1)))
