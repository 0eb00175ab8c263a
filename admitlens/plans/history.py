"""Stored recommendation logs: read again under the present tier rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.functions.output import parse_json
from admitlens.functions.scoring import history_tier, with_history_label
from admitlens.functions.text import missing_to_null
from admitlens.operators.keyed import top_n
from admitlens.rules import RULES, TIERS, Rules

ITEM = (
    "struct<university_name:string,major_name:string,score_line:string,score_diff:string,plan_count:string,reason:string,"
    "evidence_summary:string,score_line_history:array<struct<year:int,total_score_line:int>>,"
    "plan_history:array<struct<year:int,plan_count:int>>>"
)
SUMMARY = "struct<candidate_count:int,returned_count:int,rush:int,stable:int,safe:int>"
RESULT = f"struct<summary:{SUMMARY},recommendations:map<string,array<{ITEM}>>>"
REQUEST = (
    "struct<target_year:string,major_name:string,major_category:string,total_score:string,degree_type:string,study_mode:string>"
)


def parsed_logs(logs: DataFrame) -> DataFrame:
    """Request, result and warnings of each log; broken JSON counts as missing."""
    return logs.withColumns(
        {
            "request": parse_json(F.col("request_json"), REQUEST),
            "result": parse_json(F.col("result_summary_json"), RESULT),
            "log_warnings": parse_json(F.col("warning_json"), "array<string>", F.array().cast("array<string>")),
        }
    )


def _tiered(items: Column, tier_name: str, rules: Rules) -> Column:
    """The items of one tier with its label, in display order. Works inside the row."""
    sign = 1.0 if tier_name == "rush" else -1.0

    def keyed(i: Column, at: Column) -> Column:
        diff = F.coalesce(i["score_diff"].try_cast("double"), F.lit(0.0))
        plan = F.greatest(F.lit(0), F.coalesce(i["plan_count"].try_cast("int"), F.lit(0)))
        relabeled = i.withField("reason", with_history_label(i["reason"], F.lit(tier_name)))
        return F.struct(
            (diff * sign).alias("k1"), (-plan).alias("k2"), F.coalesce(i["university_name"], F.lit("")).alias("k3"), at.alias("k4"),
            relabeled.alias("item"),
        )

    mine = F.filter(items, lambda i: history_tier(i["score_diff"].try_cast("double"), rules) == tier_name)
    return F.transform(F.array_sort(F.transform(mine, keyed)), lambda s: s["item"])


def reclassify(logs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Logs with their items in the tiers the margin gives now, and with new counts.

    A log without items keeps its stored counts. Each log is handled inside its own row.
    """
    rows = parsed_logs(logs)
    stored = F.col("result.recommendations")
    items = F.flatten(F.filter(F.map_values(stored), lambda a: a.isNotNull()))
    has_items = stored.isNotNull()
    rows = rows.withColumns({t: F.when(has_items, _tiered(items, t, rules)) for t in TIERS})
    counts = {f"{t}_count": F.coalesce(F.when(has_items, F.size(t)).otherwise(F.col(f"result.summary.{t}")), F.lit(0)) for t in TIERS}
    returned = F.when(has_items, sum((F.size(t) for t in TIERS[1:]), F.size(TIERS[0]))).otherwise(F.col("result.summary.returned_count"))
    major = F.coalesce(
        missing_to_null(F.col("request.major_name")), missing_to_null(F.col("request.major_category")), F.lit("未填写")
    )
    return rows.withColumns(counts).withColumns(
        {
            "target_year": F.col("request.target_year"),
            "major_name": major,
            "total_score": F.col("request.total_score"),
            "returned_count": F.coalesce(returned, F.lit(0)),
        }
    )


def user_history(logs: DataFrame, limit: int | None = None, rules: Rules = RULES) -> DataFrame:
    """The logs of each user re-tiered: the newest `limit` of them, or all."""
    newest = logs if limit is None else top_n(logs, ["user_id"], [F.desc("created_at"), F.desc("id")], limit)
    return reclassify(newest, rules)


def one_record(logs: DataFrame, user_id: int, log_id: int) -> DataFrame:
    return reclassify(logs.filter((F.col("user_id") == user_id) & (F.col("id") == log_id)))


def newest_by_trace(logs: DataFrame) -> DataFrame:
    """The last log of every trace id."""
    return top_n(logs, ["trace_id"], [F.desc("id")])
