"""Integrated rows -> cleaned tables and the quality-issue table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens import schemas
from admitlens.functions.codes import line_type_std
from admitlens.functions.text import clean_text, composite_key, first_int, int_or_last, is_yes, joined_key, number_in, strip
from admitlens.operators.keyed import best_row, consecutive_ids, first_wins, later_rows, null_safe_join, top_n
from admitlens.operators.quality import ISSUE_COLUMNS, collect_issues, conflicting_values, domain_check, issue, missing_checks
from admitlens.rules import ADVICE, EXPECTED_YEARS, REQUIRED_FIELDS
from admitlens.sources.readers import require_columns
from admitlens.sources.stage import staged

LINE = "_line_no"
NUMBERS = [
    "plan_recruit_number", "min_score", "score_total", "score_politics", "score_english", "score_special_one",
    "score_special_two", "score_diff_to_national", "score_diff_politics", "score_diff_english", "rate_sort",
]
PLAN_KEY = ["school_id", "year", "plan_id", "research_area", "exam_subject_clean"]
LINE_KEY = [
    *PLAN_KEY, "score_line_type", "score_depart_id", "score_code", "score_degree_type", "score_total_int",
]
MAJOR_KEY = ["school_id", "depart_id", "special_code", "study_mode_std", "research_area", "exam_subject_clean"]
RATE_KEY = ["school_id", "subject_code"]


_ROW_NAMES = {
    "department_name": "depart_name", "major_code": "special_code", "major_name": "special_name",
    "degree_type": "degree_type_std", "study_mode": "study_mode_std", "research_direction": "research_area",
    "exam_subjects": "exam_subject_clean",
}

# The prepared column behind a column of a cleaned table, where names differ.
SOURCES = {
    "departments": {"department_name": "depart_name", "standard_name": "depart_name"},
    "majors": _ROW_NAMES,
    "enrollment_plans": {**_ROW_NAMES, "plan_count": "plan_recruit_number_int", "min_score": "min_score_int"},
    "score_lines": {
        **_ROW_NAMES, "total_score_line": "score_total_int", "politics_line": "score_politics_int",
        "english_line": "score_english_int", "subject_one_line": "score_special_one_int",
        "subject_two_line": "score_special_two_int", "score_diff_to_national": "score_diff_to_national_int",
        "score_diff_politics": "score_diff_politics_int", "score_diff_english": "score_diff_english_int",
    },
    "subject_level_rates": {"rate_sort": "rate_sort_int", "has_doctor": "has_doctor_int"},
}

# Further columns that keys, ranks and conditions of an output read.
ALSO_READ = {
    "departments": ["school_id", "depart_name"],
    "majors": [*MAJOR_KEY, "year", "exam_book_clean", "research_area_note", "intro_id", "level1_name", "major_category_code"],
    "enrollment_plans": PLAN_KEY,
    "score_lines": [*LINE_KEY, "score_line_type", "score_total"],
    "subject_level_rates": [*RATE_KEY, "level_rate", "rate_sort", "has_doctor", "subject_degree_type_std", "degree_type_std"],
    "admission_records": [],
    "quality_issues": [*REQUIRED_FIELDS, *LINE_KEY, "exam_book_clean", "score_total", "level_rate", "plan_recruit_number", *RATE_KEY],
}


def columns_read(outputs: Iterable[str]) -> list[str]:
    """The integrated columns that the named tables, and `quality_issues`, are made of."""
    read = set()
    for table in outputs:
        names = SOURCES.get(table, {})
        read |= {*ALSO_READ[table], *([names.get(c, c) for c in schemas.CLEANED[table]] if table in SOURCES else [])}
    read = {c.removesuffix("_int") for c in read}
    return [c for c in schemas.INTEGRATED if c in read]


class LazyTables(Mapping):
    """Tables by name, each planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[DataFrame], DataFrame]], rows: DataFrame) -> None:
        self._makers, self._rows, self._made = makers, rows, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self._rows)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass(frozen=True)
class Cleaned:
    """The prepared rows, the cleaned tables, and the issues; tables are planned and issues found when they are asked for."""

    rows: DataFrame
    batch: str
    source_file: str
    school_list: DataFrame | None = None

    @cached_property
    def tables(self) -> LazyTables:
        return LazyTables(TABLE_MAKERS, self.rows)

    @cached_property
    def issues(self) -> DataFrame:
        stages = issue_stages(self.rows)
        if self.school_list is not None:
            stages.append(schools_without_plans(self.rows, self.school_list, self.batch, self.source_file))
        return numbered_issues(stages)


def direction_key() -> Column:
    return composite_key(
        {
            "school_id": F.col("school_id"),
            "year": F.col("year"),
            "plan_id": F.col("plan_id"),
            "research_area": F.col("research_area"),
            "exam_subject": F.col("exam_subject_clean"),
        }
    )


def prepare_rows(raw: DataFrame, batch: str, source_file: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Clean every column, or those of `columns`, add batch, source and number columns; raw texts of required fields stay as `_raw_*`."""
    made = [c for c in schemas.INTEGRATED if columns is None or c in columns]
    required = [c for c in REQUIRED_FIELDS if c in made]
    require_columns(raw, required)
    absent = [c for c in made if c not in raw.columns]
    wide = raw.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])
    cleaned = [clean_text(F.col(c).cast("string")).alias(c) for c in made if c != "batch_id"]
    raws = [F.col(c).cast("string").alias(f"_raw_{c}") for c in required]
    rows = wide.select(LINE, F.lit(batch).alias("batch_id"), F.lit(source_file).alias("source_file"), *cleaned, *raws)
    numbers = {f"{c}_int": number_in(F.col(c)) for c in NUMBERS if c in made}
    return rows.withColumns({**numbers, **({"has_doctor_int": is_yes(F.col("has_doctor"))} if "has_doctor" in made else {})})


def row_issues(rows: DataFrame) -> DataFrame:
    """Issues found by looking at one row: required fields, year, optional fields."""
    key = direction_key()
    raw = {f: F.col(f"_raw_{f}") for f in REQUIRED_FIELDS}
    none = F.lit("")

    def optional(condition: Column, table: str, field: str, advice: str) -> Column:
        return F.when(condition, issue(table, field, "missing_optional", none, key, ADVICE[advice]))

    checks = [
        *missing_checks(REQUIRED_FIELDS, raw, "integrated_csv", key, "missing_required", ADVICE["missing_required"]),
        domain_check("year", EXPECTED_YEARS, "integrated_csv", key, "invalid_year", ADVICE["invalid_year"]),
        optional(F.col("exam_book_clean").isNull(), "majors", "exam_book_clean", "exam_book_clean"),
        optional(F.col("score_total").isNull(), "score_lines", "score_total", "score_total"),
        optional(
            F.col("subject_code").isNotNull() & F.col("level_rate").isNull(), "subject_level_rates", "level_rate", "level_rate"
        ),
        optional(F.col("plan_recruit_number_int").isNull(), "enrollment_plans", "plan_count", "plan_count"),
    ]
    return collect_issues(rows, checks, keep=["batch_id", "source_file", LINE]).withColumn("_position", F.col(LINE))


def duplicate_issues(rows: DataFrame, keys: list[str], table: str, field: str, raw: Column, advice: str) -> DataFrame:
    """One issue for every row after the first of its key."""
    made = issue(table, field, "duplicate", raw, direction_key(), advice)
    later = later_rows(rows, keys, LINE).select("batch_id", "source_file", LINE, made.alias("_issue"))
    return later.select("batch_id", "source_file", LINE, F.lit(0).alias("_ordinal"), "_issue.*", F.col(LINE).alias("_position"))


def rate_conflicts(rows: DataFrame) -> DataFrame:
    """Subjects of a school with more than one level."""
    rated = rows.filter(F.col("subject_code").isNotNull())
    conflicts = conflicting_values(rated, RATE_KEY, "level_rate")
    # A conflict is noticed at the first line with a level that is not the subject's first line.
    opening = rated.groupBy(*RATE_KEY).agg(F.min(LINE).alias("_first"))
    early = top_n(rated.filter(F.col("level_rate").isNotNull()), RATE_KEY, [F.col(LINE)], 2)
    lines = early.groupBy(*RATE_KEY).agg(
        F.min(LINE).alias("_a"), F.max(LINE).alias("_b"), F.first("batch_id").alias("batch_id"),
        F.first("source_file").alias("source_file"),
    )
    joined = null_safe_join(null_safe_join(conflicts, lines, RATE_KEY, "inner"), opening, RATE_KEY, "inner")
    key = composite_key({"school_id": F.col("school_id"), "subject_code": F.col("subject_code")})
    made = issue("subject_level_rates", "level_rate", "inconsistent", F.col("values"), key, ADVICE["rate_conflict"])
    position = F.when(F.col("_a") == F.col("_first"), F.col("_b")).otherwise(F.col("_a"))
    return joined.select("batch_id", "source_file", position.alias("_position"), made.alias("_issue")).select(
        "batch_id", "source_file", F.lit(None).cast("bigint").alias(LINE), F.lit(0).alias("_ordinal"), "_issue.*", "_position"
    )


def schools_without_plans(rows: DataFrame, school_list: DataFrame, batch: str, source_file: str) -> DataFrame:
    """Listed schools that no row belongs to. The list has `school_id`, `school_name` and `_pos`."""
    listed = school_list.withColumn("school_id", strip(F.col("school_id").cast("string"))).filter(F.col("school_id") != "")
    absent = null_safe_join(listed, rows.select("school_id").distinct(), ["school_id"], "left_anti")
    name = F.coalesce(clean_text(F.col("school_name")), F.lit(""))
    made = issue(
        "enrollment_plans", "school_id", "missing_plan_rows", F.concat(F.col("school_id"), F.lit(" "), name),
        composite_key({"school_id": F.col("school_id")}), ADVICE["missing_plan_rows"],
    )
    return absent.select(F.col("_pos").cast("bigint").alias("_position"), made.alias("_issue")).select(
        F.lit(batch).alias("batch_id"), F.lit(source_file).alias("source_file"), F.lit(None).cast("bigint").alias(LINE),
        F.lit(0).alias("_ordinal"), "_issue.*", "_position",
    )


def numbered_issues(stages: list[DataFrame]) -> DataFrame:
    """All stages in emission order with ids 1..n."""
    tagged = [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)]
    together = reduce(DataFrame.unionByName, tagged)
    ids = consecutive_ids(together, "_stage", "_position", ["_ordinal", "record_key"], "issue_id")
    return ids.select(
        "issue_id", "batch_id", "source_file", F.col(LINE).alias("line_no"), *ISSUE_COLUMNS, F.lit("open").alias("status")
    )


def departments(rows: DataFrame) -> DataFrame:
    kept = first_wins(rows, ["school_id", "depart_name"], LINE)
    return _as_table(kept, "departments")


def majors(rows: DataFrame) -> DataFrame:
    """Per direction the most complete row, then the newest year."""
    rank = [
        F.col("exam_book_clean").isNull(), F.col("research_area_note").isNull(), F.col("intro_id").isNull(),
        first_int(F.col("year")).desc_nulls_last(),
    ]
    kept = best_row(rows, MAJOR_KEY, rank, LINE)
    kept = kept.withColumn("major_category", F.coalesce("level1_name", "major_category_code"))
    return _as_table(kept, "majors")


def enrollment_plans(rows: DataFrame) -> DataFrame:
    kept = first_wins(rows, PLAN_KEY, LINE).withColumns(
        {
            "recommended_exemption_count": F.lit(None).cast("bigint"),
            "unified_exam_count": F.lit(None).cast("bigint"),
        }
    )
    return _as_table(kept, "enrollment_plans")


def with_total(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("score_total_int").isNotNull())


def score_lines(rows: DataFrame) -> DataFrame:
    kept = first_wins(with_total(rows), LINE_KEY, LINE).withColumn("line_type", line_type_std(F.col("score_line_type")))
    return _as_table(kept, "score_lines")


def subject_level_rates(rows: DataFrame) -> DataFrame:
    """Per school and subject the row with a level, then with a sort value, then with a doctoral point."""
    rank = [F.col("level_rate").isNull(), F.col("rate_sort_int").isNull(), F.col("has_doctor_int") != 1]
    kept = best_row(rows.filter(F.col("subject_code").isNotNull()), RATE_KEY, rank, LINE)
    kept = kept.withColumn("degree_type", F.coalesce("subject_degree_type_std", "degree_type_std"))
    return _as_table(kept, "subject_level_rates")


def admission_records(rows: DataFrame) -> DataFrame:
    """Empty: the sources have no admission records."""
    names = [F.lit(None).cast("string").alias(c) for c in schemas.CLEANED["admission_records"]]
    return rows.limit(0).select(*names)


def _as_table(df: DataFrame, table: str) -> DataFrame:
    names = SOURCES[table]
    cols = [F.col(names.get(c, c)).alias(c) for c in schemas.CLEANED[table]]
    return df.select(LINE, *cols)


TABLE_MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "departments": departments,
    "majors": majors,
    "enrollment_plans": enrollment_plans,
    "score_lines": score_lines,
    "subject_level_rates": subject_level_rates,
    "admission_records": admission_records,
}


def issue_stages(rows: DataFrame) -> list[DataFrame]:
    """Issues in the order in which they are found."""
    line_key = joined_key(*[F.col(k) for k in LINE_KEY])
    return [
        row_issues(rows),
        duplicate_issues(rows, PLAN_KEY, "enrollment_plans", "direction_key", direction_key(), ADVICE["duplicate_plan"]),
        duplicate_issues(with_total(rows), LINE_KEY, "score_lines", "score_line_key", line_key, ADVICE["duplicate_line"]),
        rate_conflicts(rows),
    ]


def clean(
    raw: DataFrame, batch: str, source_file: str, school_list: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = staged, columns: Sequence[str] | None = None,
) -> Cleaned:
    """All cleaned tables (with `_line_no` for later steps) and the numbered issues.

    The prepared rows feed every output, so they are written once (`keep`). With `columns` (see `columns_read`) they have no others,
    and only outputs made of these can be asked for.
    """
    return Cleaned(keep(prepare_rows(raw, batch, source_file, columns)), batch, source_file, school_list)


def in_file_order(df: DataFrame, table: str) -> DataFrame:
    """Rows of a cleaned table in export order (numeric ids by value, missing last). For exports only."""
    keys = {
        "departments": [int_or_last(F.col("school_id")), F.col("department_name")],
        "majors": [
            int_or_last(F.col("school_id")), int_or_last(F.col("year")), "department_name", "major_code",
            "research_direction", "exam_subjects",
        ],
        "subject_level_rates": [int_or_last(F.col("school_id")), F.col("subject_code")],
    }
    by_plan = [
        int_or_last(F.col("school_id")), int_or_last(F.col("year")), int_or_last(F.col("plan_id")), "research_direction",
        "exam_subjects",
    ]
    return df.orderBy(*keys.get(table, by_plan)).select(*schemas.CLEANED[table])


def summary(cleaned: Cleaned, school_list: DataFrame | None = None) -> DataFrame:
    """Counts of a cleaning run as rows (section, name, value)."""

    def row(section: str, df: DataFrame, name: Column | str, value: Column) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        grouped = df.groupBy(label.alias("name")).agg(value.alias("value"))
        return grouped.select(F.lit(section).alias("section"), F.col("name").cast("string").alias("name"), F.col("value").cast("bigint").alias("value"))

    def total(section: str, df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.alias("value")).select(
            F.lit(section).alias("section"), F.lit(name).alias("name"), F.col("value").cast("bigint").alias("value")
        )

    n = F.count(F.lit(1))
    rows = cleaned.rows
    per_key = rows.groupBy(*PLAN_KEY).agg(n.alias("n"))
    parts = [
        total("input", rows, "input_row_count", n),
        total("input", rows, "school_count_in_csv", F.count_distinct(F.coalesce("school_id", F.lit("")))),
        total("input", per_key, "duplicate_direction_key_count", F.coalesce(F.sum(F.col("n") - 1), F.lit(0))),
        row("years", rows, F.coalesce(F.col("year"), F.lit("")), n),
        *[total("output", t, name, n) for name, t in cleaned.tables.items()],
        total("output", cleaned.issues, "quality_issues", n),
        row("issue_types", cleaned.issues, F.col("issue_type"), n),
    ]
    if school_list is not None:
        listed = school_list.withColumn("school_id", strip(F.col("school_id").cast("string")))
        absent = null_safe_join(listed, rows.select("school_id").distinct(), ["school_id"], "left_anti")
        parts += [
            total("input", listed.filter(F.col("school_id") != ""), "school_count_in_school_list", F.count_distinct("school_id")),
            total("input", absent, "missing_school_without_plan_count", n),
        ]
    return reduce(DataFrame.unionByName, parts)
