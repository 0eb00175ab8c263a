"""Expressions that turn source codes and flags into standard values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitlens.functions.text import any_contains, clean_text, strict_int, strip, strip_or_null

# Synonyms of the three line types.
LINE_TYPE_WORDS = {
    "major": ["major", "school_major", "专业线"],
    "university": ["university", "school", "院校线"],
    "national": ["national", "国家线"],
}

# Data type of a raw score row -> line type.
SOURCE_LINE_TYPES = {"score_level": "university", "school_score": "major"}

# Flag column -> level name, in output order.
LEVEL_FLAGS = {"is_985": "985", "is_211": "211", "syl": "双一流", "is_zihuaxian": "自划线"}
DEFAULT_LEVEL = "普通院校"
DEFAULT_AREA = "A区"

# First two digits of a major code -> discipline.
DISCIPLINES = {
    "01": "哲学",
    "02": "经济学",
    "03": "法学",
    "04": "教育学",
    "05": "文学",
    "06": "历史学",
    "07": "理学",
    "08": "工学",
    "09": "农学",
    "10": "医学",
    "11": "军事学",
    "12": "管理学",
    "13": "交叉学科",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def line_type_std(c: Column) -> Column:
    text = clean_text(c)
    out = F.coalesce(text, F.lit("major"))
    for standard, words in LINE_TYPE_WORDS.items():
        out = F.when(text.isin(words), F.lit(standard)).otherwise(out)
    return out


def source_line_type(c: Column) -> Column:
    return F.try_element_at(literal_map(SOURCE_LINE_TYPES), c)


def degree_type_std(c: Column) -> Column:
    """1 / 专 -> professional, 2 / 学 -> academic, else NULL."""
    code, text = strict_int(c), strip(c.cast("string"))
    return (
        F.when(code == 1, F.lit("professional"))
        .when(code == 2, F.lit("academic"))
        .when(text.contains("专"), F.lit("professional"))
        .when(text.contains("学"), F.lit("academic"))
    )


def study_mode_std(c: Column) -> Column:
    """Part-time is tested first because its name contains the full-time one."""
    return F.when(c.contains("非全"), F.lit("part_time")).when(c.contains("全日制"), F.lit("full_time"))


def school_level(flags: dict[str, Column]) -> Column:
    """Flag columns -> `985 / 211 / ..`, or the default level."""
    named = [F.when(strict_int(flags[f]) == 1, F.lit(name)) for f, name in LEVEL_FLAGS.items() if f in flags]
    joined = F.concat_ws(" / ", *named)
    return F.when(joined == "", F.lit(DEFAULT_LEVEL)).otherwise(joined)


def province_area(c: Column) -> Column:
    text = strip_or_null(c.cast("string"))
    return (
        F.when(text.isin("A", "A区"), F.lit("A区"))
        .when(text.isin("B", "B区"), F.lit("B区"))
        .otherwise(F.coalesce(text, F.lit(DEFAULT_AREA)))
    )


def coverage_priority(level: Column) -> Column:
    text = F.coalesce(level, F.lit(""))
    return (
        F.when(any_contains(text, ["985", "自划线"]), F.lit("P0"))
        .when(any_contains(text, ["211", "双一流"]), F.lit("P1"))
        .otherwise(F.lit("P2"))
    )


def category_code(major_code: Column) -> Column:
    return F.when(major_code != "", F.substring(major_code, 1, 2))


def discipline(major_code: Column) -> Column:
    return F.try_element_at(literal_map(DISCIPLINES), category_code(major_code))


def research_areas(areas: Column, year: Column, default_year: Column) -> Column:
    """Rows of the plan's year, else of the default year, else of all years.

    The first of the two years that is a key decides, also when its list is empty;
    an empty decision falls through to every year's rows. NULL when there are none.
    """
    keyed = F.coalesce(F.try_element_at(areas, year), F.try_element_at(areas, default_year))
    whole = F.flatten(F.filter(F.map_values(areas), lambda rows: rows.isNotNull()))
    return F.when(F.size(keyed) > 0, keyed).when(F.size(whole) > 0, whole)


def enum_rank(c: Column, order: list[str]) -> Column:
    """Position in a fixed order; unknown values come first (0)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0))


def label(c: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(literal_map(names), c), F.lit(default))
