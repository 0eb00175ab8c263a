"""Recommendation logs, reports and chat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.functions.chat import ChatRules
from admitlens.functions.output import parse_json
from admitlens.plans import catalog, chat, history, reports
from workload.registry import ORACLE, query
from workload.views import Views


def logs(v: Views) -> DataFrame:
    """Every event is a stored run with two items; 'error' events have broken result JSON, 'signup' events only counts."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    request = F.to_json(F.struct(F.lit(2026).alias("target_year"), F.concat(F.lit("major "), k % 10).alias("major_name"), (k + 300).alias("total_score")))

    def item(name: str, diff, plan):
        return F.struct(
            F.lit(name).alias("university_name"), F.lit("major").alias("major_name"), (k + 200).alias("score_line"), diff.alias("score_diff"),
            plan.alias("plan_count"), F.lit("可作为保底目标：x").alias("reason"),
        )

    both = F.struct(
        F.struct(F.lit(9).alias("candidate_count")).alias("summary"),
        F.create_map(F.lit("safe"), F.array(item("B", k - 50, k), item("A", k - 20, F.lit(5)))).alias("recommendations"),
    )
    counts = F.struct(F.struct(F.lit(9).alias("candidate_count"), k.alias("returned_count"), F.lit(1).alias("rush"), F.lit(2).alias("stable"), F.lit(3).alias("safe")).alias("summary"))
    result = F.when(e == "error", "{broken").when(e == "signup", F.to_json(counts)).otherwise(F.to_json(both))
    return v.table("events").select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("trace-"), F.floor(F.col("event_id") / 7)).alias("trace_id"),
        F.col("ts").alias("created_at"), request.alias("request_json"), result.alias("result_summary_json"),
        F.when(e == "click", F.to_json(F.array(F.lit("w1"), F.lit("w2"), F.lit("w1")))).alias("warning_json"),
    )


LOGS = """WITH e AS (SELECT event_id AS id, user_id, 'trace-' || (event_id // 7) AS trace_id, ts AS created_at, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
  items AS (SELECT id, 'B' AS name, k - 50 AS diff, k AS plan FROM e WHERE event_type NOT IN ('error', 'signup')
    UNION ALL SELECT id, 'A', k - 20, 5 FROM e WHERE event_type NOT IN ('error', 'signup')),
  tiered AS (SELECT *, CASE WHEN diff >= 25 THEN 'safe' WHEN diff >= 10 THEN 'stable' ELSE 'rush' END AS tier FROM items),
  counted AS (SELECT e.*, CASE WHEN event_type = 'signup' THEN k WHEN event_type = 'error' THEN 0 ELSE 2 END AS returned_count,
      CASE WHEN event_type = 'signup' THEN 1 ELSE (SELECT count(*) FROM tiered t WHERE t.id = e.id AND tier = 'rush') END AS rush_count,
      CASE WHEN event_type = 'signup' THEN 2 ELSE (SELECT count(*) FROM tiered t WHERE t.id = e.id AND tier = 'stable') END AS stable_count,
      CASE WHEN event_type = 'signup' THEN 3 ELSE (SELECT count(*) FROM tiered t WHERE t.id = e.id AND tier = 'safe') END AS safe_count FROM e)"""


@query(
    "history_retier", "X11 C39 C40",
    LOGS + """ SELECT id, CAST(returned_count AS INTEGER) AS returned_count, CAST(rush_count AS INTEGER) AS rush_count, CAST(stable_count AS INTEGER) AS stable_count,
      CAST(safe_count AS INTEGER) AS safe_count, 'major ' || (k % 10) AS major_name, coalesce((SELECT string_agg(name || ':' || diff, ',' ORDER BY
        CASE tier WHEN 'rush' THEN 1 WHEN 'stable' THEN 2 ELSE 3 END, CASE tier WHEN 'rush' THEN diff ELSE -diff END, -plan, name) FROM tiered t WHERE t.id = counted.id), '') AS items,
      (SELECT count(*) FROM tiered t WHERE t.id = counted.id AND tier = 'stable') > 0 AS relabeled FROM counted""",
)
def history_retier(v: Views) -> DataFrame:
    rows = history.reclassify(logs(v))
    both = F.concat(*[F.coalesce(F.col(t), F.array().cast(f"array<{history.ITEM}>")) for t in ("rush", "stable", "safe")])
    return rows.select(
        "id", "returned_count", "rush_count", "stable_count", "safe_count", "major_name",
        F.array_join(F.transform(both, lambda i: F.concat_ws(":", i["university_name"], i["score_diff"])), ",").alias("items"),
        F.coalesce(F.exists("stable", lambda i: i["reason"].startswith("可作为稳妥目标")), F.lit(False)).alias("relabeled"),
    )


@query(
    "user_history", "L7",
    LOGS + """ SELECT id, user_id, position, CAST(returned_count AS INTEGER) AS returned_count FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM counted) WHERE position <= 50""",
)
def user_history(v: Views) -> DataFrame:
    newest = catalog.newest_per_key(logs(v), ["user_id"], [F.desc("created_at"), F.desc("id")], 50)
    return history.reclassify(newest).select("id", "user_id", "position", "returned_count")


@query(
    "newest_by_trace", "W20",
    LOGS + " SELECT trace_id, max(id) AS id FROM e GROUP BY 1",
)
def newest_by_trace(v: Views) -> DataFrame:
    return history.newest_by_trace(logs(v)).select("trace_id", "id")


@query(
    "user_activity", "A24",
    LOGS + """ SELECT user_id, count(*) AS run_count, CAST(sum(returned_count) AS BIGINT) AS returned_total, '2026' AS latest_year,
      (SELECT 'major ' || m FROM (SELECT k % 10 AS m, count(*) AS n FROM e WHERE e.user_id = counted.user_id GROUP BY 1) ORDER BY n DESC, m LIMIT 1) AS top_major
    FROM counted GROUP BY user_id""",
)
def user_activity(v: Views) -> DataFrame:
    return catalog.user_activity(history.reclassify(logs(v)))


@query(
    "parsed_json", "C39",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def parsed_json(v: Views) -> DataFrame:
    body = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    parsed = parse_json(body, "struct<k:int>", F.named_struct(F.lit("k"), F.lit(-1)))
    return v.table("events").select("event_id", parsed["k"].alias("k"))



@query(
    "report_text", "X12 W20 K6",
    LOGS + """ SELECT c.id AS report_id, concat_ws(chr(10), '# 考研择校推荐报告', '', '## 一、输入信息', '- 目标年份：2026', '- 目标专业：major ' || (c.k % 10), '- 初试总分：' || (c.k + 300),
      '- 学位类型：未填写', '- 学习方式：未填写', '', '## 二、推荐概览',
      CASE WHEN c.event_type IN ('error', 'signup') THEN concat_ws(chr(10), '- 候选学校数：' || CASE c.event_type WHEN 'error' THEN 0 ELSE 9 END, '- 返回推荐数：' || returned_count,
        '- 冲刺档：' || rush_count || ' 个', '- 稳妥档：' || stable_count || ' 个', '- 保底档：' || safe_count || ' 个')
      ELSE concat_ws(chr(10), '- 冲刺档：' || rush_count || ' 个', '- 稳妥档：' || stable_count || ' 个', '- 保底档：' || safe_count || ' 个') END,
      '', '## 三、推荐明细',
      CASE WHEN c.event_type IN ('error', 'signup') THEN '当前请求没有携带完整推荐明细，仅生成推荐摘要报告。' ELSE
        concat_ws(chr(10), '### 冲刺档', coalesce(r.t, '- 暂无推荐。'), '### 稳妥档', coalesce(s.t, '- 暂无推荐。'), '### 保底档', coalesce(f.t, '- 暂无推荐。')) END,
      '', '## 四、风险提示', CASE WHEN c.event_type = 'click' THEN concat_ws(chr(10), '- w1', '- w2') ELSE '- 暂无额外风险提示。' END,
      '- 第三方采集数据可能与学校最新公告存在时间差，正式填报前需要核对学校官网。', '', '## 五、数据来源', '- test tables', '',
      '仅供参考，最终以官方招生政策和当年复试录取结果为准。') AS report_content
    FROM (SELECT * FROM counted WHERE id IN (SELECT max(id) FROM e GROUP BY trace_id)) c
    LEFT JOIN texts r ON r.id = c.id AND r.tier = 'rush' LEFT JOIN texts s ON s.id = c.id AND s.tier = 'stable' LEFT JOIN texts f ON f.id = c.id AND f.tier = 'safe'""".replace(
        " SELECT c.id AS report_id",
        """, texts AS (SELECT id, tier, string_agg(pos || '. ' || name || ' - major' || chr(10) || '   - 参考复试线：' || line || chr(10) || '   - 分数差：' ||
        CASE WHEN diff >= 0 THEN '+' ELSE '' END || diff || ' 分' || chr(10) || '   - 近年复试线：暂无数据' || chr(10) || '   - 近年招生计划：暂无数据' || chr(10) || '   - 推荐理由：可作为' ||
        CASE tier WHEN 'rush' THEN '冲刺' WHEN 'stable' THEN '稳妥' ELSE '保底' END || '目标：x', chr(10) ORDER BY pos) AS t
        FROM (SELECT t.*, e.k + 200 AS line, row_number() OVER (PARTITION BY t.id, tier ORDER BY CASE tier WHEN 'rush' THEN diff ELSE -diff END, -plan, name) AS pos
          FROM tiered t JOIN e ON e.id = t.id) GROUP BY 1, 2)
    SELECT c.id AS report_id""",
        1,
    ),
)
def report_text(v: Views) -> DataFrame:
    newest = logs(v).select("trace_id").distinct()
    out = reports.reports_for_requests(newest, logs(v), "test tables")
    return out.select(F.col("recommendation_log_id").alias("report_id"), "report_content")


RULES = ChatRules(
    school_pattern=r"([A-Za-z]+(?:tion|ment|ung))",
    major_pattern=r"(?:the|der|la) ([^，。,\s]+)",
    city_pattern=r"([A-Za-z]{2,6}ing)",
    score_pattern=r"([1-4][0-9]{2}|[1-9][0-9]?)",
    lead_pattern=r"^(The|And|In)",
    punctuation=r"[,.!?]",
    known_majors=("inger", "thand", "ungen"),
    broad_major="tion",
    category_words={"cat1": ("th", "un"), "cat2": ("in",)},
    provinces=("hing", "enti", "ier", "sch"),
    default_province="home",
    any_place="qu",
    levels={"str": "985", "ber": "211", "oui": "双一流"},
    school_types=("ent", "ist", "aux"),
    academic=("ere",),
    professional=("ing",),
    part_time=("heit",),
    full_time=("on",),
)

PLAIN = "substr(trim(regexp_replace(trim(regexp_replace(t, '[,.!?]', ' ', 'g')), '^(The|And|In)', '')), 1, 40)"
MAJOR = f"""nullif(CASE WHEN contains(t, 'inger') THEN 'inger' WHEN contains(t, 'thand') THEN 'thand' WHEN contains(t, 'ungen') THEN 'ungen'
  WHEN contains(t, 'tion') THEN 'tion' ELSE {PLAIN} END, '')"""
SLOTS = f"""nullif(regexp_extract(t, '([A-Za-z]+(?:tion|ment|ung))', 1), '') AS undergraduate_school,
  nullif(regexp_extract(t, '(?:the|der|la) ([^，。,\\s]+)', 1), '') AS undergraduate_major, {MAJOR} AS target_major,
  CASE WHEN contains({MAJOR}, 'th') OR contains({MAJOR}, 'un') THEN 'cat1' WHEN contains({MAJOR}, 'in') THEN 'cat2' END AS major_category,
  CASE WHEN contains(t, 'ere') THEN 'academic' WHEN contains(t, 'ing') THEN 'professional' END AS degree_type,
  CASE WHEN contains(t, 'heit') THEN 'part_time' WHEN contains(t, 'on') THEN 'full_time' END AS study_mode,
  CASE WHEN contains(t, 'hing') THEN 'hing' WHEN contains(t, 'enti') THEN 'enti' WHEN contains(t, 'ier') THEN 'ier' WHEN contains(t, 'sch') THEN 'sch' END AS target_province,
  nullif(regexp_extract(t, '([A-Za-z]{{2,6}}ing)', 1), '') AS target_city,
  CASE WHEN contains(t, 'str') THEN '985' WHEN contains(t, 'ber') THEN '211' WHEN contains(t, 'oui') THEN '双一流' END AS school_level_preference,
  CASE WHEN contains(t, 'ent') THEN 'ent' WHEN contains(t, 'ist') THEN 'ist' WHEN contains(t, 'aux') THEN 'aux' END AS school_type_preference,
  TRY_CAST(nullif(regexp_extract(t, '([1-4][0-9]{{2}}|[1-9][0-9]?)', 1), '') AS INTEGER) AS estimated_score"""
SLOT_NAMES = [
    "undergraduate_school", "undergraduate_major", "target_major", "major_category", "degree_type", "study_mode", "target_province",
    "target_city", "school_level_preference", "school_type_preference", "estimated_score",
]


@query(
    "chat_slots", "C41 X13",
    f"""WITH s AS (SELECT conv_id, turn, {SLOTS} FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user'))
    SELECT conv_id, {', '.join(f'arg_max({c}, turn) FILTER ({c} IS NOT NULL) AS {c}' for c in SLOT_NAMES)} FROM s GROUP BY 1""",
)
def chat_slots(v: Views) -> DataFrame:
    return chat.latest_slots(v.table("conversations"), RULES)


def document_turns(v: Views) -> DataFrame:
    """Every line of a document is a user message of one conversation."""
    lines = v.table("documents").select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n")).alias("turn", "text"))
    return lines.withColumn("role", F.lit("user"))


@query(
    "chat_profiles", "X13 C41",
    f"""WITH turns AS (SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    s AS (SELECT conv_id, k, contains(text, 'qu') AS anywhere, {SLOTS} FROM (SELECT *, trim(text) AS t FROM turns)),
    ends AS (SELECT conv_id, max(k) AS n, min(k) FILTER (k > 5 AND estimated_score > 0) AS scored FROM s GROUP BY 1)
    SELECT e.conv_id, least(n, 5) AS form_turns, n AS user_turns, b.undergraduate_school, b.undergraduate_major, m.target_major, m.major_category, m.degree_type, m.study_mode,
      coalesce(r.target_province, CASE WHEN NOT r.anywhere THEN 'home' END) AS target_province, r.target_city, l.school_level_preference, l.school_type_preference,
      x.estimated_score, CASE WHEN n = 1 THEN 'basic_info' WHEN n = 2 THEN 'target_major' WHEN n = 3 THEN 'target_region' WHEN n = 4 THEN 'school_level'
        WHEN scored IS NULL THEN 'score_estimate' WHEN scored = n THEN 'analysis' ELSE 'recommendation' END AS next_step
    FROM ends e LEFT JOIN s b ON b.conv_id = e.conv_id AND b.k = 2 LEFT JOIN s m ON m.conv_id = e.conv_id AND m.k = 3
    LEFT JOIN s r ON r.conv_id = e.conv_id AND r.k = 4 LEFT JOIN s l ON l.conv_id = e.conv_id AND l.k = 5
    LEFT JOIN s x ON x.conv_id = e.conv_id AND x.k = e.scored""",
)
def chat_profiles(v: Views) -> DataFrame:
    return chat.chat_profiles(document_turns(v), RULES)


@query(
    "chat_requests", "X13",
    f"""SELECT conv_id AS applicant_id, 2026 AS target_year, coalesce(target_province, '{RULES.default_province}') AS province, major_category, target_major AS major_name,
      coalesce(degree_type, 'professional') AS degree_type, coalesce(study_mode, 'full_time') AS study_mode, school_level_preference AS level, 3 AS bucket_limit, estimated_score AS total_score
    FROM ({ORACLE["chat_profiles"]}) WHERE (target_major IS NOT NULL OR major_category IS NOT NULL) AND estimated_score IS NOT NULL""",
)
def chat_requests(v: Views) -> DataFrame:
    out = chat.requests_from_profiles(chat.chat_profiles(document_turns(v), RULES), 2026, rules=RULES)
    return out.withColumn("level", F.array_join("preferred_school_levels", ",")).drop("preferred_school_levels")
