"""Rule values: thresholds, weights, labels and message texts.

Everything in this module is a fixed value that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    single_subject_warning_diff: int = 5
    total_score_warning_diff: int = 10
    rush_min: int = -10
    rush_max: int = 10
    stable_min: int = 10
    safe_min: int = 25
    weight_total: float = 0.35
    weight_admission: float = 0.25
    weight_subject: float = 0.15
    weight_stability: float = 0.15
    weight_level: float = 0.10
    level_bonus: dict[str, int] = field(
        default_factory=lambda: {"985": 10, "211": 6, "双一流": 5, "普通院校": 0}
    )
    selective_levels: tuple[str, ...] = ("985", "211", "双一流")
    short_history_penalty: int = 8
    missing_plan_penalty: int = 5
    max_candidates: int | None = None
    bucket_limit: int = 5
    max_bucket_limit: int = 20
    max_lines: int | None = None
    shown_lines: int = 10
    history_years: int = 3


RULES = Rules()

# How many lines an online request looks at (candidates, evaluation, matching). The library's own default is all.
REQUEST_LIMITS = {"max_candidates": 300, "max_lines": 50}
MATCH_REQUEST_LINES = 200

TIERS = ["rush", "stable", "safe"]
TIER_LABELS = {"rush": "冲刺", "stable": "稳妥", "safe": "保底"}
REPORT_TIER_LABELS = {"rush": "冲刺档", "stable": "稳妥档", "safe": "保底档"}
DEGREE_LABELS = {"academic": "学术学位", "professional": "专业学位"}
MODE_LABELS = {"full_time": "全日制", "part_time": "非全日制"}
CONFIDENCE_LABELS = {"high": "高", "medium": "中", "low": "低", "unknown": "待核验"}
PRIORITIES = ["P0", "P1", "P2", "P3"]

# subject -> (score column, line column, label)
SUBJECTS = {
    "politics": ("politics_score", "politics_line", "政治"),
    "english": ("english_score", "english_line", "英语"),
    "subject_one": ("subject_one_score", "subject_one_line", "业务课一"),
    "subject_two": ("subject_two_score", "subject_two_line", "业务课二"),
}

EXPECTED_YEARS = ["2024", "2025", "2026"]

# Columns every integrated row must fill.
REQUIRED_FIELDS = [
    "school_id",
    "school_name",
    "year",
    "plan_id",
    "depart_id",
    "depart_name",
    "special_code",
    "special_name",
    "degree_type_std",
    "study_mode_std",
    "research_area",
    "exam_subject_clean",
]

# Advice written into quality issues.
ADVICE = {
    "missing_required": "关键字段缺失，该行不应进入 S07 正式入库。",
    "invalid_year": "S03 V2 当前只接受 2024/2025/2026 三年数据。",
    "exam_book_clean": "接口未返回参考书，保留为空，后续可人工核验补充。",
    "score_total": "未精确匹配到专业复试线，保留为空，不使用门类线兜底。",
    "level_rate": "匹配到学科代码但无评估等级，保留为空。",
    "plan_count": "接口未返回可解析招生人数，保留为空，不能按 0 处理。",
    "duplicate_plan": "方向级招生计划重复，S06 仅保留第一条。",
    "duplicate_line": "复试线匹配结果重复，S06 仅保留第一条。",
    "rate_conflict": "同一学校同一学科存在多个评估等级，已优先保留有 rate_sort 的记录。",
    "missing_plan_rows": "schoolList 有候选学校，但 planListV2 未返回近三年招生计划明细；S04 保留候选学校，S07 不生成计划行。",
}

DISCLAIMER = "仅供参考，最终以官方招生政策和当年复试录取结果为准。"

# Document types that count as evidence.
EVIDENCE_TYPES = [
    "official_plan",
    "official_score",
    "official_admission",
    "catalog",
    "plan",
    "notice",
    "score_line",
]
EVIDENCE_WORDS = ["招生简章", "招生计划", "拟招生", "复试"]

# Risk preference -> how many schools of the three tiers (reach, match, safety).
MATCH_LIMITS = {"balanced": (3, 3, 3), "aggressive": (5, 3, 1), "conservative": (1, 3, 5)}

# Known official sites by school id.
OFFICIAL_SITES = {
    252: "https://yz.cqu.edu.cn/",
    925: "https://yz.swu.edu.cn/",
    253: "https://yjsy.cqmu.edu.cn/",
    519: "https://yjs.cqupt.edu.cn/",
    255: "https://yz.chsi.com.cn/sch/schoolInfo--schId-368449.dhtml",
    258: "https://yjszs.cqjtu.edu.cn/",
    521: "https://graduate.cqnu.edu.cn/",
    1013: "http://zs.yjs.cqut.edu.cn/",
    1230: "https://yjs.cqust.edu.cn/",
    951: "https://grs.ctbu.edu.cn/",
    260: "https://graduate.sisu.edu.cn/",
    1496: "https://yjszs.cqwu.edu.cn/",
    1379: "https://yjsy.sanxiau.edu.cn/",
    871: "https://www.tmmu.edu.cn/24/list.htm",
    524: "https://www.scfai.edu.cn/yjsc/",
    1016: "https://yz.chsi.com.cn/sch/schoolInfo--schId-3416382896.dhtml",
    1015: "https://www.cqdx.gov.cn/",
    1645: "https://yjsy.cqctcm.edu.cn/",
    1643: "https://www.cqucas.ac.cn/admissions/PostgraduateEnrollment/default.html",
    1580: "https://sszt.yznu.edu.cn/",
    1529: "https://cigit.cas.cn/yjsjy/",
}

# National lines: (year, category, total, politics, english, subject one, subject two); 0 = no such line.
NATIONAL_LINES = [
    (2024, "哲学", 325, 45, 45, 68, 68),
    (2024, "经济学", 346, 48, 48, 72, 72),
    (2024, "法学", 325, 45, 45, 68, 68),
    (2024, "教育学", 350, 51, 51, 153, 0),
    (2024, "文学", 363, 54, 54, 81, 81),
    (2024, "历史学", 336, 46, 46, 138, 0),
    (2024, "理学", 279, 39, 39, 59, 59),
    (2024, "工学", 265, 38, 38, 57, 57),
    (2024, "农学", 251, 34, 34, 51, 51),
    (2024, "医学", 299, 41, 41, 123, 0),
    (2024, "军事学", 260, 37, 37, 56, 56),
    (2024, "管理学", 340, 48, 48, 72, 72),
    (2024, "艺术学", 362, 40, 40, 60, 60),
    (2024, "体育学", 300, 42, 42, 126, 0),
    (2024, "工学照顾专业", 255, 36, 36, 54, 54),
    (2024, "中医类照顾专业", 289, 39, 39, 117, 0),
    (2024, "金融", 346, 48, 48, 72, 72),
    (2024, "应用统计", 346, 48, 48, 72, 72),
    (2024, "审计", 197, 50, 100, 0, 0),
    (2024, "法律", 325, 45, 45, 68, 68),
    (2024, "教育", 350, 51, 51, 77, 77),
    (2024, "应用心理", 350, 51, 51, 153, 0),
    (2024, "体育", 300, 42, 42, 126, 0),
    (2024, "翻译", 363, 54, 54, 81, 81),
    (2024, "新闻与传播", 363, 54, 54, 81, 81),
    (2024, "文物与博物馆", 336, 46, 46, 138, 0),
    (2024, "建筑学", 265, 38, 38, 57, 57),
    (2024, "电子信息", 260, 38, 38, 57, 57),
    (2024, "机械", 260, 38, 38, 57, 57),
    (2024, "材料与化工", 260, 38, 38, 57, 57),
    (2024, "资源与环境", 260, 38, 38, 57, 57),
    (2024, "能源动力", 260, 38, 38, 57, 57),
    (2024, "土木水利", 260, 38, 38, 57, 57),
    (2024, "生物与医药", 260, 38, 38, 57, 57),
    (2024, "交通运输", 260, 38, 38, 57, 57),
    (2024, "农业", 251, 34, 34, 51, 51),
    (2024, "兽医", 251, 34, 34, 51, 51),
    (2024, "风景园林", 251, 34, 34, 51, 51),
    (2024, "临床医学", 299, 41, 41, 123, 0),
    (2024, "口腔医学", 299, 41, 41, 123, 0),
    (2024, "公共卫生", 299, 41, 41, 123, 0),
    (2024, "护理", 299, 41, 41, 123, 0),
    (2024, "药学", 299, 41, 41, 123, 0),
    (2024, "中药学", 289, 39, 39, 117, 0),
    (2024, "中医", 289, 39, 39, 117, 0),
    (2024, "工商管理", 170, 45, 90, 0, 0),
    (2024, "公共管理", 178, 45, 90, 0, 0),
    (2024, "会计", 197, 50, 100, 0, 0),
    (2024, "旅游管理", 170, 45, 90, 0, 0),
    (2024, "图书情报", 197, 50, 100, 0, 0),
    (2024, "工程管理", 178, 45, 90, 0, 0),
    (2024, "艺术", 362, 40, 40, 60, 60),
    (2025, "哲学", 330, 46, 46, 69, 69),
    (2025, "经济学", 348, 49, 49, 74, 74),
    (2025, "法学", 328, 46, 46, 69, 69),
    (2025, "教育学", 352, 52, 52, 156, 0),
    (2025, "文学", 365, 55, 55, 83, 83),
    (2025, "历史学", 338, 47, 47, 141, 0),
    (2025, "理学", 282, 40, 40, 60, 60),
    (2025, "工学", 268, 39, 39, 59, 59),
    (2025, "农学", 253, 35, 35, 53, 53),
    (2025, "医学", 302, 42, 42, 126, 0),
    (2025, "管理学", 343, 49, 49, 74, 74),
    (2025, "艺术学", 365, 41, 41, 62, 62),
    (2025, "电子信息", 263, 39, 39, 59, 59),
    (2025, "机械", 263, 39, 39, 59, 59),
    (2025, "材料与化工", 263, 39, 39, 59, 59),
    (2025, "工商管理", 172, 46, 92, 0, 0),
    (2025, "会计", 200, 51, 102, 0, 0),
]
