"""Score, tier, quality and message expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitlens.functions.codes import label
from admitlens.functions.text import any_contains
from admitlens.rules import RULES, SUBJECTS, TIER_LABELS, Rules


def text_of(*parts: Column | str) -> Column:
    """Concatenate literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def messages(*items: Column) -> Column:
    """The non-NULL messages, in order."""
    return F.filter(F.array(*items), lambda m: m.isNotNull())


def heat_score(plan_count: Column, category: Column) -> Column:
    """Plan size, plus 5 when the category is known."""
    bonus = F.when(category.isNotNull(), F.lit(5)).otherwise(F.lit(0))
    return F.round(F.coalesce(plan_count, F.lit(0)) * F.lit(1.0) + bonus, 4)


def change_rate(now: Column, before: Column) -> Column:
    """Relative change, NULL when there is nothing to compare with."""
    return F.when(before.isNotNull() & (before != 0), F.round((now - before) / before, 4))


def presence_quality(first: Column, second: Column) -> Column:
    """high with both values, medium with one, low with none."""
    both = first.isNotNull().cast("int") + second.isNotNull().cast("int")
    return F.when(both == 2, F.lit("high")).when(both == 1, F.lit("medium")).otherwise(F.lit("low"))


def line_quality(line: Column) -> Column:
    return F.when(line.isNotNull(), F.lit("medium")).otherwise(F.lit("low"))


def score_status(diff: Column, margin: int) -> Column:
    return F.when(diff < 0, F.lit("unsafe")).when(diff < margin, F.lit("warning")).otherwise(F.lit("safe"))


def subject_results(rules: Rules = RULES, score: str = "", line: str = "") -> Column:
    """One struct per subject that has a score and a line (column-name prefixes may be given)."""
    margin = rules.single_subject_warning_diff
    parts = []
    for key, (score_col, line_col, name) in SUBJECTS.items():
        s, n = F.col(score + score_col).cast("int"), F.col(line + line_col).cast("int")
        parts.append(
            F.when(
                s.isNotNull() & n.isNotNull(),
                F.struct(
                    F.lit(key).alias("subject"),
                    F.lit(name).alias("subject_name"),
                    s.alias("score"),
                    n.alias("line"),
                    (s - n).alias("diff"),
                    score_status(s - n, margin).alias("status"),
                ),
            )
        )
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def subject_diffs(line: str = "", score: str = "") -> list[Column]:
    """score - line for each subject; NULL where one is missing."""
    return [F.col(score + s).cast("int") - F.col(line + n).cast("int") for s, n, _ in SUBJECTS.values()]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def any_negative(diffs: list[Column]) -> Column:
    return _any([d < 0 for d in diffs])


def all_subjects_safe(diffs: list[Column], rules: Rules = RULES) -> Column:
    return ~_any([d < rules.single_subject_warning_diff for d in diffs])


def overall_status(total_diff: Column, diffs: list[Column], rules: Rules = RULES) -> Column:
    return (
        F.when((total_diff < 0) | any_negative(diffs), F.lit("unsafe"))
        .when((total_diff < rules.total_score_warning_diff) | ~all_subjects_safe(diffs, rules), F.lit("warning"))
        .otherwise(F.lit("safe"))
    )


def score_warnings(total_diff: Column, diffs: list[Column], rules: Rules = RULES) -> Column:
    """Messages about the total and each subject (fixed texts)."""
    total = F.when(total_diff < 0, text_of("总分低于参考线 ", F.abs(total_diff), " 分，风险较高。")).when(
        total_diff < rules.total_score_warning_diff,
        text_of("总分仅高出参考线 ", total_diff, " 分，建议谨慎评估。"),
    )
    singles = [
        F.when(d < 0, text_of(f"{name}低于参考线 ", F.abs(d), " 分。")).when(
            d < rules.single_subject_warning_diff, text_of(f"{name}仅高出参考线 ", d, " 分。")
        )
        for d, (_, _, name) in zip(diffs, SUBJECTS.values())
    ]
    return messages(total, *singles)


def tier(total_diff: Column, status: Column, level: Column, rules: Rules = RULES) -> Column:
    """safe / stable / rush by margin, then by status and school level."""
    selective = any_contains(F.coalesce(level, F.lit("")), list(rules.selective_levels))
    return (
        F.when(total_diff >= rules.safe_min, F.lit("safe"))
        .when(total_diff >= rules.stable_min, F.lit("stable"))
        .when(total_diff.between(rules.rush_min, rules.rush_max), F.lit("rush"))
        .when(status == "warning", F.lit("rush"))
        .when(selective & (total_diff <= rules.safe_min), F.lit("rush"))
        .otherwise(F.lit("stable"))
    )


def history_tier(diff: Column, rules: Rules = RULES) -> Column:
    """The rule for stored results: margin only, no lower bound."""
    d = F.coalesce(diff, F.lit(0.0))
    return F.when(d >= rules.safe_min, F.lit("safe")).when(d >= rules.stable_min, F.lit("stable")).otherwise(F.lit("rush"))


def acceptable(total_diff: Column, status: Column, diffs: list[Column], rules: Rules = RULES) -> Column:
    """Not unsafe, or only slightly below the total line with no subject below its line."""
    return (status != "unsafe") | ((total_diff >= rules.rush_min) & ~any_negative(diffs))


def plan_stability(values: Column) -> Column:
    """100 minus the coefficient of variation in percent, kept within 40..100."""
    known = F.filter(values, lambda v: v.isNotNull())
    n = F.size(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    mean = F.when(n > 0, total / n)
    square = F.aggregate(F.transform(known, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    spread = F.when(n > 0, F.sqrt(square / n))
    score = F.greatest(F.lit(40.0), F.least(F.lit(100.0), F.lit(100.0) - spread / mean * 100.0))
    return F.when(n >= 2, F.when(mean <= 0, F.lit(40.0)).otherwise(score)).when(n == 1, F.lit(60.0)).otherwise(F.lit(40.0))


def stability_from(count: Column, mean: Column, spread: Column) -> Column:
    """The same score from aggregates: count, mean and population standard deviation."""
    score = F.greatest(F.lit(40.0), F.least(F.lit(100.0), F.lit(100.0) - spread / mean * 100.0))
    return F.when(count >= 2, F.when(mean <= 0, F.lit(40.0)).otherwise(score)).when(count == 1, F.lit(60.0)).otherwise(F.lit(40.0))


def quality_score(history_len: Column, plan_count: Column, rules: Rules = RULES) -> Column:
    short = F.when(history_len < rules.history_years, F.lit(rules.short_history_penalty)).otherwise(F.lit(0))
    missing = F.when(plan_count.isNull(), F.lit(rules.missing_plan_penalty)).otherwise(F.lit(0))
    return F.greatest(F.lit(0.0), F.lit(100.0) - short - missing)


def level_score(level: Column, rules: Rules = RULES) -> Column:
    """Best bonus among the level names found in the text."""
    text = F.coalesce(level, F.lit(""))
    found = [F.when(text.contains(name), F.lit(float(value))).otherwise(F.lit(0.0)) for name, value in rules.level_bonus.items()]
    return F.greatest(F.lit(0.0), *found)


def recommend_score(
    total_diff: Column, subjects_safe: Column, stability: Column, level: Column, quality: Column, rules: Rules = RULES
) -> Column:
    margin = F.least(F.greatest(total_diff, F.lit(0)), F.lit(60)) / 60 * 100
    subject = F.when(subjects_safe, F.lit(1.0)).otherwise(F.lit(0.6))
    return (
        margin * rules.weight_total
        + F.lit(50.0 * rules.weight_admission)
        + subject * 100 * rules.weight_subject
        + stability * rules.weight_stability
        + level * 10 * rules.weight_level
        + (quality - 80) * 0.1
    )


def reason(
    school: Column, major: Column, tier_name: Column, diff: Column, plan_count: Column, plan_years: Column, line_years: Column
) -> Column:
    """One sentence about a candidate (fixed text)."""
    margin = F.when(diff >= 0, text_of("总分高出当前参考复试线 ", diff, " 分")).otherwise(
        text_of("总分低于当前参考复试线 ", F.abs(diff), " 分")
    )
    plan = F.coalesce(text_of("，当前计划招生 ", plan_count, " 人"), F.lit(""))
    lines = F.when(line_years > 0, text_of("，近三年可用复试线记录 ", line_years, " 年")).otherwise(F.lit("，近三年复试线记录不足"))
    return text_of(
        school, " ", major, " 可作为", label(tier_name, TIER_LABELS, ""), "目标：",
        margin, plan, "，近三年可用计划记录 ", plan_years, " 年", lines, "。",
    )


def item_warnings(
    total_diff: Column, diffs: list[Column], history_len: Column, plan_count: Column, rules: Rules = RULES
) -> Column:
    """Messages about one candidate, without repeats (fixed texts)."""
    short = history_len < rules.history_years
    subject = [
        F.when((d >= 0) & (d < rules.single_subject_warning_diff), F.lit(f"{name}单科分差较小。"))
        for d, (_, _, name) in zip(diffs, SUBJECTS.values())
    ]
    return F.array_distinct(
        messages(
            F.when(short, F.lit("近三年招生计划数据不足 3 年，计划稳定性仅供参考。")),
            F.when(plan_count.isNull(), F.lit("当前年份招生计划缺失。")),
            F.when(total_diff < 0, text_of("总分低于参考线 ", F.abs(total_diff), " 分，仅适合作为冲刺参考。")).when(
                total_diff < 10, F.lit("总分与参考线距离较近，建议重点关注复试比例和当年招生变化。")
            ),
            *subject,
            F.when(short, F.lit("计划趋势不足三年，稳定性判断偏保守。")),
        )
    )


def signed_diff(diff: Column) -> Column:
    return F.coalesce(F.when(diff >= 0, text_of("+", diff, " 分")).otherwise(text_of(diff, " 分")), F.lit("暂无"))


def history_text(items: Column, value: str, unit: str, sep: str = "；", empty: str = "暂无数据") -> Column:
    """`2024年 30人；2025年 31人` from an array of (year, value) structs; incomplete entries are left out."""
    known = F.filter(items, lambda i: i["year"].isNotNull() & i[value].isNotNull())
    text = F.array_join(F.transform(known, lambda i: text_of(i["year"], "年 ", i[value], unit)), sep)
    return F.when(F.size(known) > 0, text).otherwise(F.lit(empty))


def subject_summary(results: Column) -> Column:
    parts = F.transform(
        results, lambda r: text_of(r["subject_name"], " ", r["score"], "/", r["line"], "，分差 ", signed_diff(r["diff"]))
    )
    return F.when(F.size(results) > 0, F.concat(F.array_join(parts, "；"), F.lit("。"))).otherwise(F.lit("暂无单科线数据。"))


def match_score(diff: Column, level: Column, subject_level: Column) -> Column:
    """Step function of the margin, lowered for selective schools and strong subjects, within 30..99."""
    base = (
        F.when(diff >= 20, 95).when(diff >= 10, 85).when(diff >= 0, 75).when(diff >= -10, 65).when(diff >= -20, 55).otherwise(40)
    )
    text = F.coalesce(level, F.lit(""))
    level_cut = F.when(text.contains("985"), 10).when(text.contains("211"), 5).otherwise(0)
    subject_cut = F.when(subject_level.isin("A+", "A"), 5).when(subject_level.isin("A-", "B+"), 2).otherwise(0)
    return F.greatest(F.lit(30), F.least(F.lit(99), base - level_cut - subject_cut))


def subject_targets(user_score: Column, lines: dict[str, Column], placeholder_below: int = 50) -> Column:
    """Real subject lines (small values are placeholders) and target scores at 20/20/30/30 percent."""
    share = {"politics": 0.20, "english": 0.20, "subject_one": 0.30, "subject_two": 0.30}
    real = [F.when(c >= placeholder_below, c.cast("int")).alias(f"{k}_line") for k, c in lines.items()]
    goal = [F.floor(user_score * F.lit(p)).cast("int").alias(f"{k}_target") for k, p in share.items()]
    return F.struct(*real, *goal)


def source_confidence(local_hits: Column, web_hits: Column) -> Column:
    return (
        F.when((local_hits > 0) & (web_hits > 0), F.lit("high"))
        .when(local_hits > 0, F.lit("medium"))
        .when(web_hits > 0, F.lit("low"))
        .otherwise(F.lit("unknown"))
    )


def evidence_bonus(local_hits: Column, web_hits: Column) -> Column:
    return F.least(F.lit(5.0), local_hits * 2.0 + web_hits * 1.0)


def evidence_summary(local_first: Column, web_first: Column) -> Column:
    """One line from the best hit: structs with title and snippet (fixed texts)."""

    def line(prefix: str, hit: Column) -> Column:
        return F.when(hit.isNotNull(), text_of(prefix, hit["title"], "。", F.coalesce(hit["snippet"], F.lit(""))))

    return F.coalesce(
        line("本地资料匹配：", local_first), line("联网搜索匹配：", web_first), F.lit("暂无招生简章或招生计划证据匹配。")
    )


def risk_text(diff: Column) -> Column:
    return F.when(diff >= 20, F.lit("较低")).when(diff >= 10, F.lit("中等")).otherwise(F.lit("较高"))


def margin_analysis(school: Column, line: Column, score: Column, level: Column, major: Column) -> Column:
    """Markdown note about one school and one score (fixed text, no remote service)."""
    diff = score - line
    sign = F.when(diff >= 0, text_of("+", diff)).otherwise(diff.cast("string"))
    advice = F.when(diff >= 10, F.lit("建议重点关注专业课复习，确保初试成绩稳定。")).otherwise(
        F.lit("分数压线，建议同时准备其他院校作为保底选项。")
    )
    return F.concat_ws(
        "\n",
        text_of("# ", school, " 报考分析"),
        F.lit(""),
        F.lit("## 基本情况"),
        text_of("- 学校层次：", F.coalesce(level, F.lit("普通院校"))),
        text_of("- 目标专业：", F.coalesce(major, F.lit("未知"))),
        text_of("- 复试分数线：", line, "分"),
        text_of("- 预估分数：", score, "分"),
        text_of("- 分数差：", sign, "分"),
        F.lit(""),
        F.lit("## 报考风险"),
        text_of(
            "当前分数", F.when(diff > 0, F.lit("高出")).otherwise(F.lit("低于")), "复试线 ", F.abs(diff),
            " 分，报考风险为 **", risk_text(diff), "**。",
        ),
        F.lit(""),
        F.lit("## 建议"),
        advice,
    )


def school_remark(rank: Column, prefix: str) -> Column:
    return F.concat_ws("；", F.lit(prefix), text_of("软科/第三方排名参考：", rank))


def with_history_label(reason_text: Column, tier_name: Column) -> Column:
    """Put the tier's label into a stored reason sentence."""
    swapped = [
        F.when(tier_name == t, F.regexp_replace(reason_text, "可作为(冲刺|稳妥|保底)目标", f"可作为{name}目标"))
        for t, name in TIER_LABELS.items()
    ]
    return F.coalesce(*swapped, reason_text)


def plan_number(c: Column) -> Column:
    """A usable plan size: missing and negative count as 0."""
    return F.greatest(F.lit(0), F.coalesce(c.cast("int"), F.lit(0)))


def tier_sort_diff(tier_name: Column, diff: Column) -> Column:
    """Ascending sort key: rush by growing margin, the other tiers by falling margin."""
    return F.when(tier_name == "rush", diff).otherwise(-diff)
