"""Slot expressions over chat text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitlens.functions.text import any_contains, missing_to_null, strip


@dataclass(frozen=True)
class ChatRules:
    """Patterns and word lists. Give others for other languages."""

    school_pattern: str = r"([\x{4e00}-\x{9fa5}A-Za-z0-9]+(?:大学|学院|学校))"
    major_pattern: str = r"(?:专业是|本科专业是|学的是|读的是|专业[:：])((?U)[^，。,\s]+)"
    city_pattern: str = r"([\x{4e00}-\x{9fa5}]{2,6}市)"
    score_pattern: str = r"(500|[1-4]\d{2}|[1-9]\d?)"
    lead_pattern: str = r"^(我想|想|准备|打算|报考|考|目标是|专业是)"
    punctuation: str = r"[，。,.！!？?]"
    known_majors: tuple[str, ...] = (
        "计算机技术", "人工智能", "软件工程", "计算机科学与技术", "电子信息", "教育学", "心理学",
    )
    broad_major: str = "计算机"
    category_words: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"工学": ("计算机", "软件", "人工智能", "电子信息"), "教育学": ("教育", "心理")}
    )
    provinces: tuple[str, ...] = ("重庆", "四川", "北京", "上海", "广东", "江苏", "浙江", "湖北", "陕西", "天津")
    default_province: str = "重庆"
    any_place: str = "不限"
    levels: dict[str, str] = field(
        default_factory=lambda: {"985": "985", "211": "211", "双一流": "双一流", "普通": "普通院校"}
    )
    school_types: tuple[str, ...] = ("综合", "理工", "师范", "医药", "财经", "政法")
    academic: tuple[str, ...] = ("学硕", "学术")
    professional: tuple[str, ...] = ("专硕", "专业学位")
    part_time: tuple[str, ...] = ("非全", "非全日制")
    full_time: tuple[str, ...] = ("全日制",)


CHAT = ChatRules()


def _group(text: Column, pattern: str) -> Column:
    return missing_to_null(F.regexp_extract(text, pattern, 1))


def _first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first word of the list (not of the text) that occurs."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def plain_value(text: Column, rules: ChatRules = CHAT) -> Column:
    """The message without punctuation and opening words, 40 characters at most."""
    quiet = strip(F.regexp_replace(text, rules.punctuation, " "))
    return F.substring(strip(F.regexp_replace(quiet, rules.lead_pattern, "")), 1, 40)


def school(text: Column, rules: ChatRules = CHAT) -> Column:
    return _group(strip(text), rules.school_pattern)


def studied_major(text: Column, rules: ChatRules = CHAT) -> Column:
    return _group(strip(text), rules.major_pattern)


def target_major(text: Column, rules: ChatRules = CHAT) -> Column:
    t = strip(text)
    return missing_to_null(
        F.coalesce(
            _first_word(t, rules.known_majors),
            F.when(t.contains(rules.broad_major), F.lit(rules.broad_major)),
            plain_value(t, rules),
        )
    )


def category_of(major: Column, rules: ChatRules = CHAT) -> Column:
    return F.coalesce(*[F.when(any_contains(major, list(ws)), F.lit(c)) for c, ws in rules.category_words.items()])


def degree(text: Column, rules: ChatRules = CHAT) -> Column:
    return F.when(any_contains(text, list(rules.academic)), F.lit("academic")).when(
        any_contains(text, list(rules.professional)), F.lit("professional")
    )


def mode(text: Column, rules: ChatRules = CHAT) -> Column:
    return F.when(any_contains(text, list(rules.part_time)), F.lit("part_time")).when(
        any_contains(text, list(rules.full_time)), F.lit("full_time")
    )


def province(text: Column, rules: ChatRules = CHAT) -> Column:
    return _first_word(text, rules.provinces)


def city(text: Column, rules: ChatRules = CHAT) -> Column:
    return _group(strip(text), rules.city_pattern)


def level(text: Column, rules: ChatRules = CHAT) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(name)) for w, name in rules.levels.items()])


def school_type(text: Column, rules: ChatRules = CHAT) -> Column:
    return _first_word(text, rules.school_types)


def score(text: Column, rules: ChatRules = CHAT) -> Column:
    return F.regexp_extract(strip(text), rules.score_pattern, 1).try_cast("int")


def slots(text: Column, rules: ChatRules = CHAT) -> dict[str, Column]:
    """All slots a message could fill."""
    major = target_major(text, rules)
    return {
        "undergraduate_school": school(text, rules),
        "undergraduate_major": studied_major(text, rules),
        "target_major": major,
        "major_category": category_of(major, rules),
        "degree_type": degree(text, rules),
        "study_mode": mode(text, rules),
        "target_province": province(text, rules),
        "target_city": city(text, rules),
        "school_level_preference": level(text, rules),
        "school_type_preference": school_type(text, rules),
        "estimated_score": score(text, rules),
    }
