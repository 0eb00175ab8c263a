"""Profiles from chat turns: one profile and next step per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.functions import chat as slot
from admitlens.functions.chat import CHAT, ChatRules
from admitlens.operators.keyed import top_n

# The steps in order. The first user message opens the talk and fills nothing.
STEPS = [
    "greeting", "basic_info", "target_major", "target_region", "school_level", "score_estimate", "analysis", "recommendation",
]
FORM_TURNS = 5  # opening, basic info, major, region, level: one user message each


def latest_slots(turns: DataFrame, rules: ChatRules = CHAT, conv: str = "conv_id") -> DataFrame:
    """Per conversation the newest value of every slot over its user messages.

    `max_by` combines inside each map task, so a long conversation is never gathered.
    """
    user = turns.filter(F.col("role") == "user")
    found = slot.slots(F.col("text"), rules)
    latest = [F.max_by(c, F.when(c.isNotNull(), F.col("turn"))).alias(name) for name, c in found.items()]
    return user.groupBy(conv).agg(*latest)


def chat_profiles(turns: DataFrame, rules: ChatRules = CHAT, conv: str = "conv_id") -> DataFrame:
    """The profile a step-by-step dialogue collects, and the step it has reached.

    Each of the first five user messages answers one step; after them the first message with a score fills the
    estimate. Only the first five user messages and the first six with a score can matter, so only those are kept.
    """
    user = turns.filter(F.col("role") == "user").select(conv, "turn", "text")
    form = top_n(user, [conv], [F.col("turn")], FORM_TURNS, rank="k")

    def at(k: int, value: Column) -> Column:
        return F.max(F.when(F.col("k") == k, value))

    major = slot.target_major(F.col("text"), rules)
    region = slot.province(F.col("text"), rules)
    default_region = F.when(~F.col("text").contains(rules.any_place), F.lit(rules.default_province))
    filled = form.groupBy(conv).agg(
        F.count(F.lit(1)).alias("form_turns"),
        at(2, slot.school(F.col("text"), rules)).alias("undergraduate_school"),
        at(2, slot.studied_major(F.col("text"), rules)).alias("undergraduate_major"),
        at(3, major).alias("target_major"),
        at(3, slot.category_of(major, rules)).alias("major_category"),
        at(3, slot.degree(F.col("text"), rules)).alias("degree_type"),
        at(3, slot.mode(F.col("text"), rules)).alias("study_mode"),
        at(4, F.coalesce(region, default_region)).alias("target_province"),
        at(4, slot.city(F.col("text"), rules)).alias("target_city"),
        at(5, slot.level(F.col("text"), rules)).alias("school_level_preference"),
        at(5, slot.school_type(F.col("text"), rules)).alias("school_type_preference"),
        F.max(F.when(F.col("k") == FORM_TURNS, F.col("turn"))).alias("_form_end"),
    )
    scored = user.withColumn("_score", slot.score(F.col("text"), rules)).filter(F.col("_score") > 0)
    early = top_n(scored.select(conv, "turn", "_score"), [conv], [F.col("turn")], FORM_TURNS + 1)
    estimates = early.groupBy(conv).agg(F.collect_list(F.struct("turn", "_score")).alias("_scores"))
    last = user.groupBy(conv).agg(F.max("turn").alias("_last"), F.count(F.lit(1)).alias("user_turns"))
    joined = filled.join(last, conv).join(estimates, conv, "left")
    first_after = F.array_min(F.filter("_scores", lambda s: s["turn"] > F.col("_form_end")))
    rows = joined.withColumn("_estimate", first_after).withColumn("estimated_score", F.col("_estimate._score"))
    scored_at = F.col("_estimate.turn")
    step = (
        F.when(F.col("form_turns") < FORM_TURNS, F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.col("form_turns").cast("int") + 1))
        .when(scored_at.isNull(), F.lit("score_estimate"))
        .when(scored_at == F.col("_last"), F.lit("analysis"))
        .otherwise(F.lit("recommendation"))
    )
    return rows.withColumn("next_step", step).drop("_form_end", "_scores", "_last", "_estimate")


def next_missing(major: Column, category: Column, score: Column) -> Column:
    """The step that still lacks its answer before a recommendation can be made."""
    return (
        F.when(major.isNull() & category.isNull(), F.lit("target_major"))
        .when(score.isNull(), F.lit("score_estimate"))
        .otherwise(F.lit("recommendation"))
    )


def requests_from_profiles(profiles: DataFrame, target_year: int, conv: str = "conv_id", rules: ChatRules = CHAT) -> DataFrame:
    """Finished profiles as recommendation requests (fixed defaults)."""
    ready = next_missing(F.col("target_major"), F.col("major_category"), F.col("estimated_score")) == "recommendation"
    level = F.col("school_level_preference")
    return profiles.filter(ready).select(
        F.col(conv).alias("applicant_id"),
        F.lit(target_year).alias("target_year"),
        F.coalesce("target_province", F.lit(rules.default_province)).alias("province"),
        "major_category",
        F.col("target_major").alias("major_name"),
        F.coalesce("degree_type", F.lit("professional")).alias("degree_type"),
        F.coalesce("study_mode", F.lit("full_time")).alias("study_mode"),
        F.when(level.isNotNull(), F.array(level)).alias("preferred_school_levels"),
        F.lit(3).alias("bucket_limit"),
        F.col("estimated_score").alias("total_score"),
    )


def profile_text(labels: dict[str, str]) -> Column:
    """`label：value` lines of the filled slots, in the given order."""
    parts = [F.concat(F.lit(f"{name}："), F.col(c).cast("string")) for c, name in labels.items()]
    text = F.concat_ws("\n", *parts)
    return F.when(text == "", F.lit("暂无")).otherwise(text)
