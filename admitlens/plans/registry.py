"""School candidates -> universities and their source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.functions.codes import coverage_priority, province_area, school_level
from admitlens.functions.scoring import school_remark
from admitlens.functions.text import batch_time, strict_int, strip_or_null
from admitlens.operators.keyed import first_wins
from admitlens.operators.quality import not_one_to_one, raise_if_any
from admitlens.plans.load import with_new_ids
from admitlens.sources.sinks import upsert

SCHOOL_LIST = "school_list"
UNIVERSITY_UPDATES = [
    "province", "city", "province_area", "school_type", "school_org_type", "school_level", "coverage_priority",
    "candidate_source_url", "recruit_number_reference", "major_number_reference", "crawler_run_id",
    "candidate_crawled_at", "remark",
]
SOURCE_KEY = ["university_id", "document_type", "document_title"]
LONG_SOURCE_KEY = [*SOURCE_KEY, "source_url", "local_path"]
SOURCE_UPDATES = ["collector", "source_url", "local_path", "process_status", "official_verified", "remark"]


def _number(*cols: Column) -> Column:
    """The first number that is neither missing nor zero."""
    return F.coalesce(*[F.nullif(strict_int(c), F.lit(0).cast("bigint")) for c in cols])


def candidates(rows: DataFrame, line: str, default_province: str = "重庆", city: str = "重庆市") -> DataFrame:
    """One candidate per school, from a school list (flags) or from integrated rows (ready level)."""

    def col(name: str) -> Column:
        return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")

    ready = "school_level" in rows.columns
    flags = {f: col(f) for f in ("is_985", "is_211", "syl", "is_zihuaxian")}
    typed = rows.select(
        F.col(line).alias("_line"),
        strict_int(col("school_id")).alias("candidate_school_id"),
        strip_or_null(col("school_name")).alias("university_name"),
        F.coalesce(strip_or_null(col("province_name")), F.lit(default_province)).alias("province"),
        F.lit(city).alias("city"),
        province_area(col("province_area")).alias("province_area"),
        strip_or_null(col("type_name")).alias("school_type"),
        strip_or_null(col("type_school_name")).alias("school_org_type"),
        (strip_or_null(col("school_level")) if ready else school_level(flags)).alias("school_level"),
        _number(col("school_recruit_number_reference"), col("recruit_number_int"), col("recruit_number")).alias("recruit_number_reference"),
        _number(col("school_major_number_reference"), col("major_number")).alias("major_number_reference"),
        strip_or_null(col("rk_rank")).alias("rk_rank"),
    )
    return first_wins(typed, ["candidate_school_id"], "_line")


def check_candidates(rows: DataFrame) -> None:
    """Ids and names must be present and belong together one to one."""
    pairs = rows.select(
        strict_int(F.col("school_id").cast("string")).alias("school_id"), strip_or_null(F.col("school_name")).alias("school_name")
    ).distinct()
    raise_if_any(pairs.filter("school_id is null or school_name is null"), "school without id or name")
    raise_if_any(not_one_to_one(pairs, "school_id", "school_name"), "school id and name do not match one to one")


def university_rows(
    found: DataFrame, batch: str, source_url: str, run_id: int | None = None, remark: str = "候选库初始化"
) -> DataFrame:
    return found.select(
        "candidate_school_id", "university_name", "province", "city", "province_area", "school_type", "school_org_type",
        "school_level", coverage_priority(F.col("school_level")).alias("coverage_priority"),
        F.lit(source_url).alias("candidate_source_url"), "recruit_number_reference", "major_number_reference",
        F.lit(run_id).cast("bigint").alias("crawler_run_id"), batch_time(F.lit(batch)).alias("candidate_crawled_at"),
        F.lit("pending").alias("official_verified_status"), school_remark(F.col("rk_rank"), remark).alias("remark"),
    )


def register_universities(target: DataFrame, new_rows: DataFrame) -> DataFrame:
    keys = ["candidate_school_id"]
    return with_new_ids(upsert(target, new_rows, keys, UNIVERSITY_UPDATES), keys)


def source_rows(
    found: DataFrame, universities: DataFrame, title: str, source_url: str, local_path: str, collector: str, remark: str
) -> DataFrame:
    """One school-list source per candidate."""
    ids = universities.select(F.col("id").alias("university_id"), "candidate_school_id")
    return found.join(ids, "candidate_school_id").select(
        "university_id", F.lit(SCHOOL_LIST).alias("document_type"), F.lit(title).alias("document_title"),
        F.lit(source_url).alias("source_url"), F.lit(local_path).alias("local_path"), F.lit(collector).alias("collector"),
        F.lit(remark).alias("remark"),
    )


def register_sources(target: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Update the sources whose logical key exists, add the others.

    School lists keep one record per (university, type, title); other documents also compare URL and path,
    with a missing value equal to empty text.
    """
    loaded = new_rows.withColumns({"process_status": F.lit("loaded"), "official_verified": F.lit(0)})

    lists = f"document_type = '{SCHOOL_LIST}'"
    long_keys = ["university_id", "document_type", "document_title", "_url", "_path"]
    t = target.filter(f"NOT ({lists})").withColumns(_plain_place())
    s = loaded.filter(f"NOT ({lists})").withColumns(_plain_place())
    others = upsert(t, s, long_keys, SOURCE_UPDATES).drop("_url", "_path")
    both = upsert(target.filter(lists), loaded.filter(lists), SOURCE_KEY, SOURCE_UPDATES).unionByName(others)
    return with_new_ids(both, LONG_SOURCE_KEY)


def _plain_place() -> dict[str, Column]:
    return {"_url": F.coalesce("source_url", F.lit("")), "_path": F.coalesce("local_path", F.lit(""))}


def set_source_status(target: DataFrame, source_id: int, status: str, remark: str | None = None) -> DataFrame:
    here = F.col("id") == source_id
    out = target.withColumn("process_status", F.when(here, F.lit(status)).otherwise(F.col("process_status")))
    if remark is None:
        return out
    return out.withColumn("remark", F.when(here, F.lit(remark)).otherwise(F.col("remark")))
