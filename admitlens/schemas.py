"""Column lists and types of the files and tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the integrated file, in file order.
INTEGRATED = [
    "batch_id", "source_api", "source_status", "error_message", "school_id", "school_name",
    "province_name", "city", "province_area", "type_name", "type_school_name", "is_985", "is_211",
    "syl", "is_zihuaxian", "school_level", "school_recruit_number_reference",
    "school_major_number_reference", "rk_rank", "year", "plan_id", "spe_id", "depart_id",
    "depart_name", "special_code", "special_name", "major_category_code", "level1_code",
    "level1_name", "level2_code", "level2_name", "degree_type", "degree_type_std",
    "degree_type_name", "recruit_type", "recruit_type_name", "study_mode_std", "exam_class",
    "exam_class_name", "research_area", "exam_subject", "exam_subject_clean",
    "research_area_note", "is_statistic_direction", "exam_book", "exam_book_clean",
    "exam_book_year", "intro_id", "plan_recruit_number", "plan_remark", "min_score",
    "score_years_json", "major_rate", "doctoral_point", "score_data_type", "score_line_type",
    "score_depart_id", "score_depart_name", "score_code", "score_name", "score_degree_type",
    "score_total", "score_politics", "score_english", "score_special_one", "score_special_two",
    "score_diff_to_national", "score_diff_politics", "score_diff_english", "score_note",
    "score_special_remark", "subject_code", "subject_name", "subject_degree_type",
    "subject_degree_type_std", "level_rate", "rate_sort", "has_doctor",
]

# Columns of the cleaned tables, in file order.
CLEANED = {
    "departments": [
        "batch_id", "school_id", "school_name", "depart_id", "department_name", "standard_name", "source_file",
    ],
    "majors": [
        "batch_id", "school_id", "school_name", "depart_id", "department_name", "year", "plan_id", "spe_id",
        "major_code", "major_name", "major_category_code", "major_category", "level1_code", "level1_name",
        "level2_code", "level2_name", "degree_type", "degree_type_name", "study_mode", "recruit_type",
        "recruit_type_name", "exam_class", "exam_class_name", "research_direction", "research_area_note",
        "exam_subjects", "exam_book_clean", "exam_book_year", "intro_id", "source_file",
    ],
    "enrollment_plans": [
        "batch_id", "year", "school_id", "school_name", "depart_id", "department_name", "plan_id", "major_code",
        "major_name", "degree_type", "study_mode", "research_direction", "exam_subjects", "plan_count",
        "recommended_exemption_count", "unified_exam_count", "min_score", "score_years_json", "plan_remark",
        "source_file",
    ],
    "score_lines": [
        "batch_id", "year", "school_id", "school_name", "depart_id", "department_name", "plan_id", "major_code",
        "major_name", "degree_type", "study_mode", "research_direction", "exam_subjects", "line_type",
        "score_data_type", "score_depart_id", "score_depart_name", "score_code", "score_name",
        "score_degree_type", "total_score_line", "politics_line", "english_line", "subject_one_line",
        "subject_two_line", "score_diff_to_national", "score_diff_politics", "score_diff_english", "score_note",
        "score_special_remark", "source_file",
    ],
    "subject_level_rates": [
        "batch_id", "school_id", "school_name", "subject_code", "subject_name", "degree_type", "level_rate",
        "rate_sort", "has_doctor", "major_rate", "doctoral_point", "source_file",
    ],
    "admission_records": [
        "batch_id", "year", "school_id", "school_name", "depart_id", "department_name", "major_code",
        "major_name", "research_direction", "candidate_no_hash", "initial_total_score", "politics_score",
        "english_score", "subject_one_score", "subject_two_score", "reexam_score", "final_score",
        "admission_status", "source_file",
    ],
    "quality_issues": [
        "issue_id", "batch_id", "source_file", "line_no", "table_name", "field_name", "issue_type", "raw_value",
        "record_key", "suggestion", "status",
    ],
}

# Columns that carry numbers; the others are text.
LONGS = {"school_id", "depart_id", "plan_id", "spe_id", "issue_id", "line_no"}
INTS = {
    "year", "plan_count", "recommended_exemption_count", "unified_exam_count", "total_score_line",
    "politics_line", "english_line", "subject_one_line", "subject_two_line", "score_diff_to_national",
}
DECIMALS = {
    "initial_total_score", "politics_score", "english_score", "subject_one_score", "subject_two_score",
    "reexam_score", "final_score",
}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def typed_schema(table: str) -> T.StructType:
    """Declared types of a cleaned table once it is stored."""

    def kind(c: str) -> T.DataType:
        if c in LONGS:
            return T.LongType()
        if c in INTS:
            return T.IntegerType()
        return T.DecimalType(8, 2) if c in DECIMALS else T.StringType()

    return T.StructType([T.StructField(c, kind(c)) for c in CLEANED[table]])


# Key columns of the loaded tables.
TABLE_KEYS = {
    "universities": ["candidate_school_id"],
    "departments": ["university_id", "department_name"],
    "majors": ["university_id", "department_id", "major_code", "study_mode", "research_direction"],
    "enrollment_plans": ["year", "university_id", "major_id"],
    "score_lines": ["year", "line_type", "university_id", "major_id", "major_category"],
    "major_statistics": ["year", "university_id", "major_id"],
    "subject_level_rates": ["university_id", "subject_code"],
}

ISSUE_KEY = ["source_id", "table_name", "field_name", "issue_type", "raw_value", "suggestion", "status"]

# Fields of the raw collections.
_AREA = "struct<research_area:string,exam_subject:string,recruit_number:string,note:string,is_statistic_direction:string>"
DETAIL_DATA = (
    "struct<depart_id:string,depart_name:string,special_code:string,special_name:string,level1_code:string,"
    "level1_name:string,level2_code:string,level2_name:string,spe_id:string,degree_type_name:string,"
    "recruit_type:string,recruit_type_name:string,exam_class:string,exam_class_name:string,exam_book:string,"
    "exam_book_year:string,intro_id:string,recruit_number:string,min_score:string,score_years:string,"
    f"major_rate:string,doctoral_point:string,default_year:string,research_area_data:map<string,array<{_AREA}>>>"
)
DETAIL_ENTRY = f"struct<plan_id:string,source_status:string,error_message:string,data:{DETAIL_DATA}>"
RAW = {
    "schools": [
        "school_id", "school_name", "province_name", "province_area", "type_name", "type_school_name", "is_985",
        "is_211", "syl", "is_zihuaxian", "recruit_number", "major_number", "rk_rank",
    ],
    "plans": [
        "school_id", "year", "plan_id", "spe_id", "depart_id", "depart_name", "special_code", "special_name",
        "level1_code", "level1_name", "level2_code", "level2_name", "degree_type", "degree_type_name",
        "recruit_type_name", "exam_class_name", "recruit_number", "remark",
    ],
    "scores": [
        "school_id", "year", "data_type", "depart_id", "depart_name", "code", "name", "degree_type", "total",
        "politics", "english", "special_one", "special_two", "diff_total", "diff_politics", "diff_english",
        "note", "special_remark",
    ],
    "levels": ["school_id", "code", "code_name", "degree_type", "rate", "rate_sort", "has_doctor"],
}

# Keys by which repeated raw records are dropped.
RAW_KEYS = {
    "schools": ["school_id"],
    "plans": ["school_id", "year", "plan_id"],
    "scores": ["school_id", "year", "data_type", "depart_id", "code", "name", "degree_type"],
    "levels": ["school_id", "code", "degree_type", "rate"],
}
