"""School matching by score margin and risk preference, for a table of applicants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.functions.scoring import match_score, subject_targets
from admitlens.operators.candidates import Filter, attach, candidates
from admitlens.operators.joins import first_theta_match
from admitlens.operators.keyed import top_n
from admitlens.rules import MATCH_LIMITS

# The three groups (reach, match, safety).
GROUPS = ["chong", "wen", "bao"]

MATCH_FILTERS = [
    Filter("major_category", ("major_category",)),
    Filter("target_major", ("major_name",), "contains"),
    Filter("province", ("province",)),
    Filter("school_level", ("school_level",), "contains"),
    Filter("school_type", ("school_type",)),
    Filter("degree_type", ("degree_type",)),
]


def recent_lines(lines: DataFrame, universities: DataFrame, majors: DataFrame, since: int = 2023) -> DataFrame:
    """Lines with their school and major, from a first year on."""
    u = universities.select(F.col("id").alias("university_id"), "university_name", "province", "city", "school_type", "school_level")
    m = majors.select(F.col("id").alias("major_id"), "major_name", "major_category", "degree_type", "exam_subjects")
    used = lines.filter(F.col("total_score_line").isNotNull() & (F.col("year") >= since))
    used = used.withColumnsRenamed({"id": "score_line_id", "major_category": "score_major_category"})
    return used.join(u, "university_id").join(m, "major_id")


ORDER = [("total_score_line", "desc"), ("score_line_id", "asc")]


def school_candidates(
    applicants: DataFrame, lines: DataFrame, rates: DataFrame, max_lines: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(applicants with their profile, per profile one line per school with the school's subject level).

    A school keeps its highest line, of the best `max_lines` of the profile or of all.
    """
    if max_lines is None:
        met = candidates(applicants, lines, MATCH_FILTERS, [], ORDER, ["university_id"])
        asked, schools = met.asked, met.best(1, lines.columns)
    else:
        met = candidates(applicants, lines, MATCH_FILTERS, [], ORDER)
        asked, schools = met.asked, top_n(met.best(max_lines, lines.columns), ["_profile", "university_id"], [F.col("_rank")])
    start = F.coalesce(F.substring("major_name", 1, 4), F.lit(""))
    r = rates.select("university_id", F.col("id").alias("_rate_id"), "subject_name", F.col("level_rate").alias("subject_level"))
    rated = first_theta_match(
        schools, r, "university_id", F.col("subject_name").contains(start), ["_profile", "university_id"],
        [F.col("_rate_id").asc_nulls_last()], "subject_level",
    )
    return asked, rated.drop("_rate_id", "subject_name")


def match_schools(
    applicants: DataFrame, lines: DataFrame, rates: DataFrame, max_lines: int | None = None, keep: Sequence[str] = ("applicant_id",),
) -> DataFrame:
    """Reach, match and safety schools per applicant; how many of each depends on the risk preference."""
    asked, schools = school_candidates(applicants, lines, rates, max_lines)
    pairs = attach(asked.select(*keep, "user_score", "risk_preference", "_profile"), schools, keep)
    diff = F.col("user_score") - F.col("total_score_line")
    rows = pairs.withColumn("score_diff", diff).withColumn(
        "rank_group",
        F.when(F.col("score_diff").between(-20, -1), F.lit("chong"))
        .when(F.col("score_diff").between(0, 15), F.lit("wen"))
        .when(F.col("score_diff") > 15, F.lit("bao")),
    )
    rows = rows.filter(F.col("rank_group").isNotNull())
    signed = F.when(F.col("rank_group") == "chong", -F.col("score_diff")).otherwise(F.col("score_diff"))
    most = max(max(v) for v in MATCH_LIMITS.values())
    ranked = top_n(rows, [*keep, "rank_group"], [signed, F.col("score_line_id")], most, rank="position")
    allowed = F.coalesce(
        *[
            F.when((F.col("risk_preference") == p) & (F.col("rank_group") == g), F.lit(n))
            for p, limits in MATCH_LIMITS.items()
            for g, n in zip(GROUPS, limits)
        ],
        *[F.when(F.col("rank_group") == g, F.lit(n)) for g, n in zip(GROUPS, MATCH_LIMITS["conservative"])],
    )
    kept = ranked.filter(F.col("position") <= allowed)
    subject_lines = {s: F.col(f"{s}_line") for s in ("politics", "english", "subject_one", "subject_two")}
    return kept.select(
        *keep, "rank_group", "position", "university_id", "university_name", "province", "city", "school_level", "school_type",
        F.col("total_score_line").alias("score_line"), "score_diff", "subject_level", F.col("major_name").alias("matching_major"),
        match_score(F.col("score_diff"), F.col("school_level"), F.col("subject_level")).alias("match_score"),
        subject_targets(F.col("user_score"), subject_lines).alias("subject_scores"), "exam_subjects", "year",
    )
