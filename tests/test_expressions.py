"""Expressions on small rows with boundary values."""

import pytest
from pyspark.sql import functions as F

from admitlens.functions import chat, codes, output, scoring, text
from admitlens.plans import evidence
from admitlens.rules import RULES


def one(spark, **columns):
    """Evaluate columns on a single row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    "raw, want",
    [(" Ａ１　ｂ\t c\n", "A1 ｂ c"), ("", None), ("　", None), (None, None), ("a  b", "a b"), ("x\x1cy", "x y")],
)
def test_clean_text(spark, raw, want):
    assert one(spark, v=text.clean_text(lit(raw))).v == want


@pytest.mark.parametrize("raw, want", [("约12人", 12), ("12.5", 12), ("-3 x", -3), ("１２", 12), ("none", None), ("", None), (None, None)])
def test_first_int(spark, raw, want):
    assert one(spark, v=text.first_int(lit(raw))).v == want


def test_three_number_parsers_differ(spark):
    r = one(spark, a=text.strict_int(lit("12.5")), b=text.float_int(lit("12.5")), c=text.first_int(lit("12.5")), d=text.strict_int(lit(" 7 ")))
    assert (r.a, r.b, r.c, r.d) == (None, 12, 12, 7)


@pytest.mark.parametrize("raw, want", [("是", 1), ("yes", 1), ("TRUE", 1), ("no", 0), ("", 0), (None, 0)])
def test_bool_int(spark, raw, want):
    assert one(spark, v=text.bool_int(lit(raw))).v == want


def test_clean_html(spark):
    r = one(spark, v=text.clean_html(lit("<p>a</p><BR/> b <br> <i></i><br>c")))
    assert r.v == "a\nb\nc"


def test_issue_keys(spark):
    key = text.composite_key({"school_id": lit("7"), "year": lit(None)})
    r = one(
        spark, key=key, a=text.school_id_from_issue(key, lit("x")), b=text.school_id_from_issue(lit(""), lit("12 name")),
        c=text.school_id_from_issue(lit(""), lit("name")), d=text.combined_raw_value(lit(""), key), e=text.issue_type_std(lit(None)),
    )
    assert (r.key, r.a, r.b, r.c, r.d, r.e) == ("school_id=7|year=", "7", "12", None, "school_id=7|year=", "missing")


def test_batch_ids(spark):
    r = one(
        spark, a=text.batch_from_path(lit("/x/int_20240102_030405.csv"), "int_"), b=text.batch_from_path(lit("/r/full_v2/school_list/school_list.json"), "int_"),
        c=text.batch_time(lit("full_v2")), d=text.batch_time(lit("20240102_030405")).cast("string"),
    )
    assert (r.a, r.b, r.c, r.d) == ("20240102_030405", "full_v2", None, "2024-01-02 03:04:05")


@pytest.mark.parametrize("length", [0, 1, 439, 440, 520, 521, 880, 881, 1400])
def test_text_chunks(spark, length):
    body = "".join(chr(97 + i % 26) for i in range(length))
    want = [body] if length <= 520 else [body[s : s + 520] for s in range(0, length, 440)]
    assert one(spark, v=text.text_chunks(lit(body))).v == want


def test_best_chunk_counts_and_takes_the_first(spark):
    body = "重庆大学 招生简章 计算机技术 招生计划 127 人。其他说明。"
    r = one(spark, v=text.best_chunk(lit(body), F.array(lit("重庆大学"), lit("计算机技术"), lit("招生计划"))), n=text.best_chunk(lit(body), F.array(lit("xyz"))))
    assert r.v.score >= 3 and "计算机技术" in r.v.chunk and r.n is None
    assert one(spark, v=text.occurrences(lit("aaaa"), lit("aa"))).v == 2


def test_snippet_and_file_match(spark):
    assert one(spark, v=text.snippet(lit("a" * 300))).v == "a" * 219 + "…"
    yes = text.file_matches(lit("重庆师范大学2026年目录.pdf"), lit("重庆师范大学"), lit("计算机技术"), lit("2026"))
    no = text.file_matches(lit("重庆交通大学2026年目录.pdf"), lit("重庆师范大学"), lit("计算机技术"), lit("2026"))
    major = text.file_matches(lit("计算机 技术2026.pdf"), lit(None), lit("计算机技术"), lit("2026"))
    r = one(spark, a=yes, b=no, c=major)
    assert (r.a, r.b, r.c) == (True, False, True)


def test_codes(spark):
    r = one(
        spark, a=codes.line_type_std(lit("专业线")), b=codes.line_type_std(lit("")), c=codes.line_type_std(lit("other")), d=codes.degree_type_std(lit("1")),
        e=codes.degree_type_std(lit("学硕")), f=codes.study_mode_std(lit("非全日制")), g=codes.study_mode_std(lit("全日制")), h=codes.province_area(lit("B")),
        i=codes.school_level({"is_985": lit("1"), "is_211": lit("1"), "syl": lit("2"), "is_zihuaxian": lit(None)}), j=codes.discipline(lit("085400")),
        k=codes.coverage_priority(lit("211 / 双一流")), m=codes.enum_rank(lit("P9"), ["P0", "P1"]),
    )
    assert tuple(r) == ("major", "major", "other", "professional", "academic", "part_time", "full_time", "B区", "985 / 211", "工学", "P1", 0)


@pytest.mark.parametrize("raw, ok", [("工学", True), ("", False), ("abc", False), ("工�", False), ("å·¥工", False)])
def test_readable_category(spark, raw, ok):
    assert one(spark, v=text.readable_category(lit(raw))).v is ok


def test_research_areas_empty_first_key_skips_the_default_year(spark):
    m = F.create_map(lit("2024"), F.array().cast("array<string>"), lit("2023"), F.array(lit("x")), lit("2022"), F.array(lit("y")))
    r = one(spark, a=codes.research_areas(m, lit("2024"), lit("2023")), b=codes.research_areas(m, lit("2030"), lit("2023")), c=codes.research_areas(F.lit(None).cast("map<string,array<string>>"), lit("1"), lit("2")))
    assert (sorted(r.a), r.b, r.c) == (["x", "y"], ["x"], None)


@pytest.mark.parametrize("diff, want", [(-1, "unsafe"), (0, "warning"), (4, "warning"), (5, "safe")])
def test_score_status(spark, diff, want):
    assert one(spark, v=scoring.score_status(F.lit(diff), 5)).v == want


@pytest.mark.parametrize(
    "diff, status, level, want",
    [(5, "warning", "", "rush"), (18, "safe", "", "stable"), (30, "safe", "", "safe"), (25, "safe", "", "safe"), (10, "safe", "", "stable"),
     (-10, "unsafe", "", "rush"), (-11, "unsafe", "", "stable"), (-11, "unsafe", "985", "rush"), (-11, "warning", "", "rush")],
)
def test_tier(spark, diff, status, level, want):
    assert one(spark, v=scoring.tier(F.lit(diff), lit(status), lit(level))).v == want


def test_plan_stability(spark):
    def s(*xs):
        return scoring.plan_stability(F.array(*[lit(x, "int") for x in xs]))

    r = one(spark, steady=s(30, 31, 30), wild=s(10, 60, 20), single=s(9), none=s(None), zero=s(0, 0))
    assert r.steady > r.wild == 40.0 < 41 and (r.single, r.none, r.zero) == (60.0, 40.0, 40.0)
    assert round(r.steady, 4) == round(100 - (2 / 9) ** 0.5 / (91 / 3) * 100, 4)


def test_recommend_score_and_quality(spark):
    q = scoring.quality_score(F.lit(2), lit(None, "int"))
    score = scoring.recommend_score(F.lit(80), F.lit(True), F.lit(60.0), scoring.level_score(lit("985 / 211")), F.lit(92.0))
    r = one(spark, q=q, s=F.round(score, 6))
    assert r.q == 87.0 and r.s == round(35 + 12.5 + 15 + 9 + 10 + 1.2, 6)


@pytest.mark.parametrize("diff, level, subject, want", [(20, None, None, 95), (10, "985", "A", 70), (0, "211", "B+", 68), (-21, "985", "A+", 30), (-20, None, None, 55)])
def test_match_score(spark, diff, level, subject, want):
    assert one(spark, v=scoring.match_score(F.lit(diff), lit(level), lit(subject))).v == want


def test_subject_targets_hide_placeholder_lines(spark):
    lines = {"politics": F.lit(45), "english": F.lit(50), "subject_one": lit(None, "int"), "subject_two": F.lit(90)}
    r = one(spark, v=scoring.subject_targets(F.lit(351), lines)).v
    assert (r.politics_line, r.english_line, r.subject_one_line, r.subject_two_line, r.politics_target, r.subject_two_target) == (None, 50, None, 90, 70, 105)


def test_confidence_and_bonus(spark):
    got = [one(spark, v=scoring.source_confidence(F.lit(a), F.lit(b))).v for a, b in ((1, 1), (1, 0), (0, 1), (0, 0))]
    assert got == ["high", "medium", "low", "unknown"]
    hit = "array(named_struct('title', '招生简章', 'snippet', 's'))"
    df = spark.sql(f"select {hit} as local_hits, {hit} as web_hits, 70D as recommend_score, 80D as data_quality_score, cast(null as array<string>) as warnings")
    r = evidence.with_evidence(df).first()
    assert (r.agent_adjustment_score, r.recommend_score, r.data_quality_score, r.source_confidence) == (3.0, 73.0, 83.0, "high")
    assert "本地资料匹配" in r.evidence_summary and r.warnings == []
    bare = spark.sql("select cast(null as array<struct<title:string,snippet:string>>) local_hits, cast(null as array<struct<title:string,snippet:string>>) web_hits, 70D recommend_score, 80D data_quality_score, cast(null as array<string>) warnings")
    r = evidence.with_evidence(bare).first()
    assert r.source_confidence == "unknown" and r.recommend_score == 70.0 and "人工核对" in r.warnings[0]


def test_messages_and_texts(spark):
    none = [lit(None, "int")] * 3
    w = scoring.score_warnings(F.lit(-4), [F.lit(2), *none])
    r = one(spark, w=w, d=scoring.signed_diff(F.lit(0)), e=scoring.signed_diff(lit(None, "int")), l=scoring.with_history_label(lit("可作为冲刺目标：x"), lit("safe")))
    assert r.w == ["总分低于参考线 4 分，风险较高。", "政治仅高出参考线 2 分。"]
    assert (r.d, r.e, r.l) == ("+0 分", "暂无", "可作为保底目标：x")


def test_chat_slots(spark):
    r = one(
        spark, a=chat.school(lit("我来自西南大学，专业是教育学")), b=chat.studied_major(lit("我来自西南大学，专业是教育学")), c=chat.target_major(lit("我想考软件工程")),
        d=chat.category_of(lit("软件工程")), e=chat.province(lit("去四川或重庆")), f=chat.level(lit("211就行")), g=chat.score(lit("大概350分")), h=chat.city(lit("在成都市读")),
        i=chat.degree(lit("专硕")), j=chat.mode(lit("非全日制")), k=chat.target_major(lit("我想学 历史。")),
    )
    assert tuple(r)[:7] == ("我来自西南大学", "教育学", "软件工程", "工学", "重庆", "211", 350)
    assert (r.h, r.i, r.j, r.k) == ("在成都市", "professional", "part_time", "学 历史")


def test_json_and_output_types(spark):
    r = one(spark, a=output.parse_json(lit("{bad"), "struct<k:int>"), b=output.parse_json(lit('{"k": 3}'), "struct<k:int>")["k"], c=text.json_compact(F.array().cast("array<int>")))
    assert (r.a, r.b, r.c) == (None, 3, None)
    row = output.output_types(spark.sql("select 1.50BD as d, date'2024-01-02' as e, timestamp_ntz'2024-01-02 03:04:05' as f")).first()
    assert tuple(row) == (1.5, "2024-01-02", "2024-01-02T03:04:05")


def test_rules_hold_their_values():
    assert (RULES.safe_min, RULES.stable_min, RULES.rush_min) == (25, 10, -10)


ODD_TEXTS = [
    "plain", " lead", "trail ", "two  blanks", "one blank", "tab\tin", "Ａ１", "教育学", "　教育学　", "教育　学", "é", "\u2028x", "x\x85", "a<b", "a>b", "<br>", " <br/> ",
    "a<br>b", "a <BR /> b", "a\n\n b", "a \x0b\t\r\n b", "a\xa0\u2029\xa0b", "a \t b", "<p> </p>", "a<i>b</i> c", "\x1ca\x1f", "", " ", "\n", None, "\U00020000 x", "x\U00020000",
]


@pytest.mark.parametrize("raw", ODD_TEXTS)
def test_texts_that_need_no_pattern_give_what_the_pattern_gives(spark, raw):
    import re

    white = "\\s\x1c-\x1f"
    plain = None if raw is None else re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>", "\n", raw))
    html = None if raw is None else "\n".join(x for x in map(str.strip, re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", plain)) if x) or None
    narrow = None if raw is None else re.sub(rf"[{white}]+", " ", raw.translate(str.maketrans(text.FULL_WIDTH, text.HALF_WIDTH))).strip(" ") or None
    r = spark.createDataFrame([(raw,)], "t string").select(text.strip(F.col("t")).alias("s"), text.clean_text(F.col("t")).alias("c"), text.clean_html(F.col("t")).alias("h")).first()
    assert (r.s, r.c, r.h) == (None if raw is None else raw.strip(), narrow, html)
