"""Files, cleaning, loading, registry, history, reports and chat on hand-made rows."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from admitlens import schemas
from admitlens.plans import chat, clean, evidence, history, load, match, recommend, registry, reports, scoring
from admitlens.sources import readers, sinks
from admitlens.sources.stage import staged


def write_csv(path, fields, rows):
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, fieldnames=fields)
        w.writeheader()
        w.writerows([{k: r.get(k, "") for k in fields} for r in rows])


def row(**over):
    base = {
        "school_id": "1", "school_name": "甲大学", "year": "2024", "plan_id": "10", "depart_id": "5", "depart_name": "计算机学院",
        "special_code": "085400", "special_name": "电子信息", "degree_type_std": "professional", "study_mode_std": "full_time",
        "research_area": "方向一", "exam_subject_clean": "政治\n英语", "plan_recruit_number": "约１２人", "score_total": "300",
        "score_line_type": "school_major", "exam_book_clean": "书,\"好\"", "subject_code": "0812", "level_rate": "A", "rate_sort": "2", "level1_name": "工学",
    }
    return {**base, **over}


ROWS = [
    row(),
    row(plan_recruit_number="12.5"),  # repeats the plan key and the score key
    row(school_id="　1 ", year="2023", plan_id="11", level_rate="B+", rate_sort=""),  # other year, other level
    row(school_id="2", school_name="乙\n大学", plan_id="12", research_area="", score_total="", exam_book_clean="", subject_code="", level_rate=""),
    row(plan_id="13", research_area="方向二", plan_recruit_number="无", year="2026", intro_id="9"),
]


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "integrated_b1.csv"
    write_csv(path, schemas.INTEGRATED, ROWS)
    raw = readers.read_integrated(spark, str(path))
    listed = spark.createDataFrame([("1", "甲大学", 0), (" 9 ", "丙　大学", 1)], "school_id string, school_name string, _pos long")
    return clean.clean(raw, "b1", "integrated.csv", listed), listed


def test_line_numbers_and_quoted_cells(cleaned):
    rows = {r._line_no: r for r in cleaned[0].rows.collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6]
    assert rows[2].exam_book_clean == '书,"好"' and rows[2].exam_subject_clean == "政治 英语"
    assert rows[4].school_id == "1" and rows[5].school_name == "乙 大学"
    assert [rows[i].plan_recruit_number_int for i in (2, 3, 6)] == [12, 12, None]


def test_cleaned_tables(cleaned):
    t = cleaned[0].tables
    assert sorted(tuple(r) for r in t["departments"].select("school_id", "department_name").collect()) == [("1", "计算机学院"), ("2", "计算机学院")]
    plans = t["enrollment_plans"].select("school_id", "year", "plan_id", "plan_count").collect()
    assert sorted((tuple(r) for r in plans), key=str) == [("1", "2023", "11", 12), ("1", "2024", "10", 12), ("1", "2026", "13", None), ("2", "2024", "12", 12)]
    assert sorted(r.plan_id for r in t["score_lines"].collect()) == ["10", "11", "13"]
    assert {r.line_type for r in t["score_lines"].collect()} == {"major"}
    majors = {r.research_direction: r.year for r in t["majors"].collect()}
    assert majors == {"方向一": "2024", None: "2024", "方向二": "2026"}
    rate = t["subject_level_rates"].first()
    assert (rate.level_rate, rate.rate_sort) == ("A", 2) and t["admission_records"].count() == 0


def test_export_order_is_numeric(spark):
    rows = [(10, "10", "2024", "9", "b", None), (11, "9", "2024", "100", "a", None), (12, "9", "2024", "20", "a", None), (13, "x", "2024", "1", "a", None)]
    df = spark.createDataFrame(rows, "_line_no long, school_id string, year string, plan_id string, research_direction string, exam_subjects string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in schemas.CLEANED["enrollment_plans"] if c not in df.columns})
    assert [r.plan_id for r in clean.in_file_order(df, "enrollment_plans").collect()] == ["20", "100", "9", "1"]


def test_issues_in_emission_order(cleaned):
    issues = cleaned[0].issues.orderBy("issue_id").collect()
    assert [i.issue_id for i in issues] == list(range(1, len(issues) + 1))
    got = [(i.line_no, i.table_name, i.field_name, i.issue_type) for i in issues]
    assert got == [
        (4, "integrated_csv", "year", "invalid_year"),
        (5, "integrated_csv", "research_area", "missing_required"),
        (5, "majors", "exam_book_clean", "missing_optional"),
        (5, "score_lines", "score_total", "missing_optional"),
        (6, "enrollment_plans", "plan_count", "missing_optional"),
        (3, "enrollment_plans", "direction_key", "duplicate"),
        (3, "score_lines", "score_line_key", "duplicate"),
        (None, "subject_level_rates", "level_rate", "inconsistent"),
        (None, "enrollment_plans", "school_id", "missing_plan_rows"),
    ]
    assert issues[7].raw_value == "A/B+" and issues[8].raw_value == "9 丙 大学" and issues[8].record_key == "school_id=9"


def test_kept_rows_and_duplicates_add_up(cleaned):
    c = cleaned[0]
    dup = c.issues.filter("table_name = 'enrollment_plans' and issue_type = 'duplicate'").count()
    assert c.tables["enrollment_plans"].count() + dup == c.rows.count()
    counts = {(r.section, r.name): r.value for r in clean.summary(*cleaned).collect()}
    assert counts[("input", "input_row_count")] == 5 and counts[("input", "duplicate_direction_key_count")] == 1
    assert counts[("input", "missing_school_without_plan_count")] == 1 and counts[("years", "2024")] == 3


def test_load_merges_and_repeats_safely(spark, cleaned, tmp_path):
    tables = {n: df for n, df in cleaned[0].tables.items() if n != "admission_records"}
    tables = {n: df.select(*[F.col(c) if c == "_line_no" else F.col(c).cast("string").alias(c) for c in df.columns]) for n, df in tables.items()}
    tables["quality_issues"] = cleaned[0].issues.withColumn("_line_no", F.col("issue_id"))
    uni = spark.createDataFrame([(100, 1), (200, 2), (900, 9)], "id long, candidate_school_id long")
    docs = spark.createDataFrame([(7, 100, "school_list"), (8, 100, "school_list"), (9, 100, "plan")], "id long, university_id long, document_type string")
    deps = spark.createDataFrame([(50, 100, "计算机学院", "old", None)], "id long, university_id long, department_name string, standard_name string, source_id long")
    majors = spark.createDataFrame([], "id long, university_id long, department_id long, major_code string, major_name string, major_category string, degree_type string, study_mode string, research_direction string, exam_subjects string, source_id long")
    base = load.build_context(uni, docs, deps, majors)
    assert load.missing_universities(tables, base).count() == 0
    ctx = load.preview(tables, base)
    load.check(tables, ctx)
    assert {r.department_id for r in ctx.departments.collect()} == {50, -1}
    prepared = load.prepare(tables, ctx)
    assert {(r.university_id, r.source_id) for r in prepared["departments"].collect()} == {(100, 8), (200, None)}
    plans = {(r.year, r.university_id): r.plan_count for r in prepared["enrollment_plans"].collect()}
    assert plans == {(2024, 100): 12, (2023, 100): 12, (2026, 100): None, (2024, 200): 12}
    assert prepared["quality_issues"].filter("source_id = 8").count() == 5
    merged = load.merge_table(deps, prepared["departments"], "departments")
    again = load.merge_table(staged(merged), prepared["departments"], "departments")
    want = {(50, 100, "计算机学院", "计算机学院", 8), (51, 200, "计算机学院", "计算机学院", None)}
    assert {tuple(r) for r in merged.collect()} == want == {tuple(r) for r in again.collect()}
    counts = {(r.section, r.name): r.value for r in load.load_counts(tables, prepared, ctx).collect()}
    assert counts[("collapsed", "majors")] == 0 and counts[("planned", "score_lines")] == 3
    stored = spark.createDataFrame([], prepared["quality_issues"].drop("_line_no").schema)
    first = staged(load.merge_issues(stored, prepared["quality_issues"]))
    assert load.merge_issues(first, prepared["quality_issues"]).count() == first.count() == 9


def test_stored_tables(spark, cleaned, tmp_path):
    tables = {n: df.select(*[F.col(c) if c == "_line_no" else F.col(c).cast("string").alias(c) for c in df.columns]) for n, df in cleaned[0].tables.items() if n != "admission_records"}
    issues = cleaned[0].issues.withColumn("_line_no", F.col("issue_id"))
    uni = spark.createDataFrame([(100, 1), (200, 2), (900, 9)], "id long, candidate_school_id long")
    docs = spark.createDataFrame([(7, 100, "school_list"), (8, 100, "school_list")], "id long, university_id long, document_type string")
    empty = load.empty_targets(spark)
    known = spark.createDataFrame([(50, 100, "计算机学院", "old", None), (60, 900, "别的学院", "kept", 1)], empty["departments"].schema)
    prepared = load.prepare_quality_issues(issues, load.build_context(uni, docs, known, empty["majors"]))
    stored = {**empty, "departments": known, "quality_issues": spark.createDataFrame([], prepared.drop("_line_no").schema)}
    load.store_tables(stored, str(tmp_path), 16)
    files = lambda name: {str(f.relative_to(tmp_path)) for f in (tmp_path / name / "rows").glob("*/*.parquet")}
    before = files("departments")
    rows = {**tables, "quality_issues": issues}
    first = load.load_stored(spark, str(tmp_path), rows, uni, docs)
    departments = {(r.id, r.university_id, r.department_name, r.standard_name) for r in sinks.stored_table(spark, str(tmp_path / "departments")).collect()}
    assert departments == {(50, 100, "计算机学院", "计算机学院"), (60, 900, "别的学院", "kept"), (61, 200, "计算机学院", "计算机学院")}
    assert len(first["departments"]) == 2 and len(before & files("departments")) == 1  # the folder of school 900 is as it was
    state = lambda: {n: sorted(map(str, sinks.stored_table(spark, str(tmp_path / n)).collect())) for n in stored}
    loaded, kept = state(), files("quality_issues")
    assert len(loaded["quality_issues"]) == 9 and len(loaded["majors"]) == len({r.split("id=")[1] for r in loaded["majors"]})
    load.load_stored(spark, str(tmp_path), rows, uni, docs)
    assert state() == loaded and files("quality_issues") == kept
    only = {"departments": tables["departments"].filter("school_id = '2'").withColumn("standard_name", F.lit("new"))}
    now = files("departments")
    assert len(load.load_stored(spark, str(tmp_path), only, uni, docs)["departments"]) == 1 and len(now & files("departments")) == len(now) - 1
    assert sinks.upsert_stored(spark, str(tmp_path / "departments"), known.limit(0).drop("id"), ["university_id", "department_name"], ["standard_name"], "university_id") == []


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"school_id": 1, "school_name": "甲", "is_985": 1}, {"school_id": "2", "school_name": "乙"}]}, ensure_ascii=False))
    found = readers.read_school_list(spark, str(tmp_path / "s.json"))
    assert [(r._pos, r.school_id, r.is_985) for r in found.orderBy("_pos").collect()] == [(0, "1", "1"), (1, "2", None)]
    registry.check_candidates(found)
    rows = registry.candidates(found, "_pos").orderBy("candidate_school_id").collect()
    assert [(r.candidate_school_id, r.school_level, r.province_area) for r in rows] == [(1, "985", "A区"), (2, "普通院校", "A区")]
    body = {"items_by_plan_id": {"5": {"plan_id": 5, "source_status": "success", "data": {"default_year": 2024, "research_area_data": {"2024": [{"research_area": "x", "recruit_number": 3}]}}}}}
    (tmp_path / "d.json").write_text(json.dumps(body))
    d = readers.read_detail_map(spark, str(tmp_path / "d.json")).first()
    assert d.plan_id == "5" and d.data.research_area_data["2024"][0].recruit_number == "3"
    (tmp_path / "l.json").write_text('{"plan_id": 1, "source_status": "success"}\n{"plan_id": 2, "sou\n')
    good, bad = readers.read_detail_lines(spark, str(tmp_path / "l.json"))
    assert good.count() == 1 and bad.count() == 1


def test_csv_layouts_and_tables(spark, tmp_path):
    deep = tmp_path / "departments"
    deep.mkdir()
    rows = [{"batch_id": "b", "school_id": "1", "department_name": "a\nb", "depart_id": "x"}]
    write_csv(deep / "departments_b.csv", schemas.CLEANED["departments"], rows)
    write_csv(tmp_path / "departments_b.csv", schemas.CLEANED["departments"], rows)
    for nested in (True, False):
        r = readers.read_cleaned(spark, str(tmp_path), "departments", "b", nested).first()
        assert (r.school_id, r.department_name, r.depart_id) == (1, "a\nb", None)
    assert readers.read_clean_dir(spark, str(tmp_path), "b", ("departments",))["departments"].first()._line_no == 2
    assert readers.latest_file(spark, [str(tmp_path / "*.json"), str(tmp_path / "dep*_b.csv")]).endswith("departments_b.csv")
    with pytest.raises(readers.SourceError):
        readers.latest_file(spark, [str(tmp_path / "*.none")])
    with pytest.raises(readers.SourceError):
        readers.require_columns(spark.range(1), ["x"])
    sinks.write_csv(spark.createDataFrame([("a,\"b", 1, 2)], "t string, n int, extra int"), str(tmp_path / "out"), ["n", "t"], single_file=True)
    assert [tuple(r) for r in readers.read_integrated(spark, str(tmp_path / "out"), numbered=False).collect()] == [("1", 'a,"b')]
    assert readers.national_lines(spark).count() == 69 and readers.national_lines(spark).filter("subject_two_line = 0").count() == 0
    path = sinks.with_snapshot(spark.range(3).toDF("id"), str(tmp_path / "t"), "1")
    assert spark.read.parquet(path).count() == 3


def applicant(spark, **over):
    base = {"applicant_id": 1, "target_year": 2024, "university_id": None, "school_id": None, "major_id": None, "major_code": None, "major_name": None,
            "major_category": "工学", "degree_type": None, "study_mode": None, "total_score": 310, "politics_score": 50, "english_score": 36,
            "subject_one_score": None, "subject_two_score": None}
    kinds = {"university_id": "long", "school_id": "long", "major_id": "long", "major_code": "string", "major_name": "string", "major_category": "string", "degree_type": "string", "study_mode": "string"}
    r = {**base, **over}
    schema = ", ".join(f"{k} {kinds.get(k, 'int')}" for k in r)
    return spark.createDataFrame([tuple(r.values())], schema)


def test_evaluation_falls_back_to_the_national_line(spark):
    lines = readers.national_lines(spark).select(
        "year", "line_type", F.lit(None).cast("long").alias("university_id"), F.lit(None).cast("long").alias("department_id"), F.lit(None).cast("long").alias("major_id"),
        F.col("major_category").alias("score_major_category"), "total_score_line", "politics_line", "english_line", "subject_one_line", "subject_two_line", "score_diff_to_national",
        F.concat_ws("-", "year", "major_category").alias("score_line_id"), F.lit(None).cast("long").alias("candidate_school_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("major_code", "major_name", "major_category", "degree_type", "study_mode")],
    )
    r = scoring.evaluate_scores(applicant(spark), lines).first()
    assert (r.line_type, r.total_score_line, r.total_score_diff, r.overall_status, r.reference_strategy) == ("national", 265, 45, "unsafe", "single_match")
    assert [(x.subject, x.status) for x in r.single_subject_results] == [("politics", "safe"), ("english", "unsafe")]
    assert r.warnings == ["未匹配到专业线，尝试回退到院校线。", "未匹配到院校线，尝试回退到国家线。", "英语低于参考线 2 分。"]
    none = scoring.evaluate_scores(applicant(spark, target_year=2001), lines).first()
    assert none.data_available is False and none.overall_status == "warning" and none.matched_line_count == 0 and len(none.warnings) == 3
    good, bad = scoring.checked_applicants(applicant(spark, target_year=1999, major_category=None, total_score=501))
    assert good.count() == 0 and bad.first().errors == ["target_year", "total_score", "major"]
    summed, _ = scoring.checked_applicants(applicant(spark, total_score=None, subject_one_score=100, subject_two_score=100))
    assert summed.first().total_score == 286


def test_each_school_once_and_tiers_sorted(spark):
    rows = [("rush", 8, 2, 10, "B", 1), ("rush", 3, 1, 10, "A", 2), ("stable", 20, 1, 9, "A", 3), ("stable", 12, 3, 9, "C", 4), ("stable", 15, 4, 1, "D", 5), ("stable", 15, 5, 2, "E", 6), ("safe", 30, 4, 1, "D", 7)]
    items = spark.createDataFrame(rows, "rank_type string, score_diff int, candidate_school_id int, plan_count int, university_name string, _rank int")
    items = items.withColumns({"applicant_id": F.lit(1), "bucket_limit": F.lit(2)})
    got = [(r.rank_type, r.position, r.candidate_school_id) for r in recommend.choose_items(items).orderBy("rank_type", "position").collect()]
    assert got == [("rush", 1, 1), ("rush", 2, 2), ("stable", 1, 5), ("stable", 2, 4)]


def test_history_reports_and_details(spark):
    item = {"university_name": "重庆大学", "major_name": "计算机技术", "score_line": 355, "score_diff": 0, "reason": "可作为保底目标：样例",
            "score_line_history": [{"year": 2025, "total_score_line": 350}, {"year": 2026, "total_score_line": 355}], "plan_history": [{"year": 2026, "plan_count": 22}]}
    request = {"target_year": 2026, "major_name": "计算机技术", "total_score": 355, "degree_type": "professional", "study_mode": "full_time"}
    logs = spark.createDataFrame(
        [(1, 5, "t1", json.dumps(request), json.dumps({"recommendations": {"safe": [item], "stable": None}}), json.dumps(["样例风险提示"]), "2024-01-01"),
         (2, 5, "t2", json.dumps({"major_category": "电子信息"}), json.dumps({"summary": {"candidate_count": 21, "returned_count": 9, "rush": 3, "stable": 3, "safe": 3}}), None, "2024-01-02"),
         (3, 5, "t3", "{bad", "[]", "x", "2024-01-03")],
        "id long, user_id long, trace_id string, request_json string, result_summary_json string, warning_json string, created_at string",
    )
    rows = {r.id: r for r in history.user_history(logs).collect()}
    assert (rows[1].rush_count, rows[1].safe_count, rows[1].returned_count) == (1, 0, 1) and rows[1].rush[0].reason == "可作为冲刺目标：样例"
    assert (rows[2].rush_count, rows[2].returned_count, rows[2].major_name) == (3, 9, "电子信息") and rows[3].major_name == "未填写"
    asked = spark.createDataFrame([("t1",), ("t2",), ("none",)], "trace_id string")
    text = {r.trace_id: r.report_content for r in reports.reports_for_requests(asked, logs, "测试数据源").collect()}
    assert "重庆大学" in text["t1"] and "2026年 355分" in text["t1"] and "2026年 22人" in text["t1"] and "样例风险提示" in text["t1"]
    assert "- 学位类型：专业学位" in text["t1"] and "候选学校数：21" in text["t2"] and "未找到对应推荐日志" in text["none"]
    assert all(reports.DISCLAIMER in t for t in text.values())


def test_chat_steps(spark):
    said = ["你好", "我是西南大学的，专业是教育学", "想考软件工程专硕", "四川成都市", "211 理工", "不知道", "350分吧", "确认"]
    turns = [(1, i, "user", t) for i, t in enumerate(said)] + [(2, 0, "user", "你好"), (2, 1, "assistant", "350"), (2, 2, "user", "不说")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.chat_profiles(df).collect()}
    a = got[1]
    assert (a.undergraduate_major, a.target_major, a.major_category, a.degree_type) == ("教育学", "软件工程", "工学", "professional")
    assert (a.target_province, a.target_city, a.school_level_preference, a.school_type_preference) == ("四川", "四川成都市", "211", "理工")
    assert (a.estimated_score, a.next_step) == (350, "recommendation") and got[2].next_step == "target_major"
    assert chat.requests_from_profiles(chat.chat_profiles(df), 2026).first().preferred_school_levels == ["211"]


def test_document_lists_and_limits(spark):
    docs = spark.createDataFrame(
        [(i, 1, 2020 + i % 6 if i % 7 else None, "plan" if i % 2 else "other", f"t{i}", None, f"/p{i}" if i != 13 else "", "词 " * 3) for i in range(60)],
        "id long, university_id long, year int, document_type string, document_title string, source_url string, local_path string, text string",
    )
    wanted = spark.createDataFrame([(1, 2023)], "university_id long, target_year int")
    usable = [(y, i) for i, y in ((i, 2020 + i % 6 if i % 7 else None) for i in range(60)) if i != 13 and (y is None or 2022 <= y <= 2023)]
    usable.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]), reverse=True)
    allowed = [i for _, i in usable if i % 2]
    assert {r.doc_id for r in evidence.registered_documents(wanted, docs).collect()} == set(allowed)
    assert {r.doc_id for r in evidence.registered_documents(wanted, docs, 5).collect()} == set(allowed[:5])
    a = spark.createDataFrame([(1, "/A", 1), (1, "/b", 2)], "item int, path string, o int")
    b = spark.createDataFrame([(1, "/a", 1), (1, "/c", 2)], "item int, path string, o int")
    kept = evidence.merged_documents(a, b, ["item"], "path", "o", limit=2)
    assert sorted(r.path for r in kept.collect()) == ["/A", "/b"]


def test_match_without_filters(spark):
    lines = spark.createDataFrame(
        [("l1", 2024, 340, 45, 1, "甲", "985", "计算机技术"), ("l2", 2024, 350, 60, 1, "甲", "985", "计算机技术"), ("l3", 2023, 320, 45, 2, "乙", None, "教育学")],
        "score_line_id string, year int, total_score_line int, politics_line int, university_id int, university_name string, school_level string, major_name string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("province", "city", "school_type", "major_category", "degree_type", "exam_subjects")}).withColumns(
        {c: F.lit(None).cast("int") for c in ("english_line", "subject_one_line", "subject_two_line")})
    rates = spark.createDataFrame([(1, 1, "计算机技术与应用", "A"), (2, 1, "计算机技术", "B")], "id int, university_id int, subject_name string, level_rate string")
    who = spark.createDataFrame([(1, 345, "balanced")], "applicant_id int, user_score int, risk_preference string").withColumns(
        {c: F.lit(None).cast("string") for c in ("major_category", "target_major", "province", "school_level", "school_type", "degree_type")})
    got = {(r.rank_group, r.university_id): (r.score_diff, r.subject_level, r.match_score) for r in match.match_schools(who, lines, rates).collect()}
    assert got == {("chong", 1): (-5, "A", 50), ("bao", 2): (25, None, 95)}


def test_integration_and_cleaning_of_some_columns(spark):
    """Fewer columns are carried, rows and numbers are those of all columns; two records of one school give two rows each."""
    from admitlens import schemas
    from admitlens.plans import integrate

    text = lambda name, rows, *more: spark.createDataFrame(
        [tuple(r.get(c) for c in (*schemas.RAW[name], *more)) for r in rows], ", ".join([*[f"{c} string" for c in schemas.RAW[name]], *[f"{c} long" for c in more]])
    )
    schools = text("schools", [{"school_id": "1", "school_name": "a"}, {"school_id": "1", "school_name": "b"}, {"school_id": "2", "school_name": "c"}])
    plan = {"year": "2024", "depart_id": "7", "depart_name": "d", "special_code": "0812", "special_name": "m", "level1_code": "08", "degree_type": "2", "recruit_number": "3"}
    plans = text("plans", [plan | {"school_id": s, "plan_id": p, "_line": n} for n, (s, p) in enumerate([("1", "p1"), ("2", "p2"), ("2", "p2"), (None, "p3"), ("3", None)])], "_line")
    area = {"research_area": "x", "exam_subject": "s1<br>s2", "recruit_number": "4", "note": None, "is_statistic_direction": None}
    details = spark.createDataFrame([("p1", "success", None, {"level2_code": "0812", "research_area_data": {"2024": [area, area | {"research_area": "y"}]}})], schemas.DETAIL_ENTRY.removeprefix("struct<").removesuffix(">"))
    score = {"year": "2024", "data_type": "school_score", "depart_id": "7", "code": "0812", "degree_type": "2", "total": "300"}
    scores = text("scores", [score | {"school_id": "1", "_line": 1}, score | {"school_id": "2", "_line": 2}, score | {"school_id": "2", "_line": 3}], "_line")
    levels = text("levels", [{"school_id": "1", "code": "0812", "rate": "A", "_line": 0}, {"school_id": "2", "code": "08", "rate": "B", "_line": 0}], "_line")
    raw = (schools, plans, details, scores, levels, "b1")
    whole = integrate.integrate(*raw)
    shown = ["school_name", "plan_id", "research_area", "score_total", "level_rate"]
    some = integrate.integrate(*raw, columns=shown)
    assert some.columns == [*shown, "_line_no"]
    assert [r._line_no for r in whole.orderBy("_line_no").collect()] == [2, 3, 4, 5, 6, 7, 8]
    rows = sorted(map(tuple, some.select(*shown).collect()), key=str)
    assert rows == sorted(map(tuple, whole.select(*shown).collect()), key=str)
    assert [r for r in rows if r[1] == "p1"] == [(s, "p1", a, "300", "A") for s in "ab" for a in "xy"] and ("c", "p2", None, None, "B") in rows
    everything = clean.clean(whole, "b1", "f")
    for output in [*clean.SOURCES, "quality_issues"]:
        of = lambda c: c.issues.drop("issue_id") if output == "quality_issues" else c.tables[output]  # noqa: B023, E731
        columns = clean.columns_read([output])
        part = clean.clean(whole.select("_line_no", *columns), "b1", "f", keep=lambda df: df, columns=columns)
        assert len(columns) < 40 and sorted(map(str, of(part).collect())) == sorted(map(str, of(everything).collect())), output


def test_result_log_shuffles_its_items_once(spark):
    from admitlens.plans import recommend

    items = spark.createDataFrame(
        [(1, "safe", 2, 30, 300), (1, "safe", 1, 40, 290), (1, "rush", 1, -5, 335), (None, "stable", 1, 12, 320)],
        "applicant_id long, rank_type string, position int, score_diff int, score_line int",
    )
    counts = spark.createDataFrame([(1, 9, 4), (2, 0, 0), (None, 3, 1)], "applicant_id long, candidate_record_count long, candidate_count long")
    log = recommend.result_log(items, counts)
    got = {r.applicant_id: json.loads(r.result_summary_json) for r in log.collect()}
    assert [i["position"] for i in got[1]["recommendations"]["safe"]] == [1, 2] and got[1]["summary"] == {"candidate_count": 4, "returned_count": 3, "rush": 1, "stable": 0, "safe": 2}
    assert list(got[None]["recommendations"]) == ["stable"] and "recommendations" not in got[2] and got[2]["summary"]["returned_count"] == 0
    plan = log._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("collect_list(") == 2 and "map_from_entries(collect_list" not in plan  # partial and final step of one group


def test_integration_carries_only_what_the_columns_are_made_of(spark, monkeypatch):
    """Scores and schools bring only the columns asked for; texts that stripping changes come out as they went in."""
    from admitlens.plans import integrate

    text = lambda name, rows, *more: spark.createDataFrame(
        [tuple(r.get(c) for c in (*schemas.RAW[name], *more)) for r in rows], ", ".join([*[f"{c} string" for c in schemas.RAW[name]], *[f"{c} long" for c in more]])
    )
    plan = {"plan_id": "p", "special_name": "m", "year": " 2024", "depart_id": "7 ", "special_code": "0812", "degree_type": "2"}
    plans = text("plans", [plan | {"school_id": s, "_line": n} for n, s in enumerate([" 1", "1", "", None])], "_line")
    details = spark.createDataFrame([], schemas.DETAIL_ENTRY.removeprefix("struct<").removesuffix(">"))
    score = {"school_id": "1", "year": "2024", "data_type": "school_score", "depart_id": "7", "code": "0812", "degree_type": "2", "total": "300", "_line": 1}
    schools = text("schools", [{"school_id": " 1", "school_name": "a", "rk_rank": "5"}, {"school_id": "1", "school_name": "b"}])
    given = {}
    number = integrate.consecutive_ids
    monkeypatch.setattr(integrate, "consecutive_ids", lambda df, *more: given.setdefault("numbered", number(given.setdefault("rows", df), *more)))
    shown = ["school_id", "school_name", "year", "depart_id", "special_code", "degree_type", "score_total"]
    out = integrate.integrate(schools, plans, details, text("scores", [score], "_line"), text("levels", [], "_line"), "b1", columns=shown)
    got = [tuple(r) for r in out.orderBy("_line_no").select(*shown).collect()]
    same = (" 2024", "7 ", "0812", "2")
    assert got == [(" 1", "a", *same, "300"), ("1", "b", *same, "300"), (None, None, *same, None), (None, None, *same, None)]
    steps = given["rows"]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [step for step in steps if "collect_list(" in step or "first(" in step]
    assert len(grouped) == 2 and not any(c in step for step in grouped for c in ("special_remark", "diff_total", "rk_rank"))


def test_load_counts_holds_no_shuffle_of_a_table(spark):
    """Each table is counted in a staged write of its own; what is read afterwards are these counts."""
    schools = spark.range(200).selectExpr("CAST(id % 7 AS STRING) AS school_id", "id AS _line_no")
    once = schools.groupBy("school_id").count()
    none = spark.createDataFrame([], "id long")
    counts = load.load_counts({"majors": schools}, {"majors": once}, load.Context(none, none, none, none))
    collapsed = counts.filter("section = 'collapsed'")
    assert [tuple(r) for r in collapsed.collect()] == [("collapsed", "majors", 193)]
    assert "school_id" not in collapsed._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.section, r.name): r.value for r in counts.collect()}[("planned", "majors")] == 7
