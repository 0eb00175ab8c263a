"""File sources."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens import schemas
from admitlens.functions.text import missing_to_null, strip_or_null
from admitlens.rules import NATIONAL_LINES, RULES, Rules
from admitlens.sources.ranges import read_csv_ranges

TABLES = tuple(schemas.CLEANED)


class SourceError(ValueError):
    """Input that cannot be used."""


def cleaned_path(base: str, table: str, batch: str, nested: bool) -> str:
    """`<base>/<table>/<table>_<batch>.csv` on a cluster file system, `<base>/<table>_<batch>.csv` otherwise."""
    file = f"{table}_{batch}.csv"
    return f"{base.rstrip('/')}/{table}/{file}" if nested else f"{base.rstrip('/')}/{file}"


def read_cleaned(spark: SparkSession, base: str, table: str, batch: str, nested: bool = False) -> DataFrame:
    """One cleaned table with its declared types; a number that cannot be read is NULL."""
    return typed(read_csv_ranges(spark, cleaned_path(base, table, batch, nested)), table)


def typed(raw: DataFrame, table: str) -> DataFrame:
    want = schemas.typed_schema(table)
    cols = []
    for f in want.fields:
        c = missing_to_null(F.col(f.name)) if f.name in raw.columns else F.lit(None)
        cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


def read_integrated(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """The integrated file with the line numbers of its records (the first is line 2), read in ranges. Fails when it has no record."""
    rows = read_csv_ranges(spark, path)
    if rows.isEmpty():
        raise SourceError(f"no records in {path}")
    return rows if numbered else rows.drop("_line_no")


def read_clean_dir(spark: SparkSession, base: str, batch: str, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """All cleaned tables as trimmed text. A missing file fails here (Spark checks the paths)."""
    out = {}
    for table in tables:
        raw = read_csv_ranges(spark, cleaned_path(base, table, batch, nested=False))
        out[table] = raw.select(*[F.col(c) if c == "_line_no" else strip_or_null(F.col(c)).alias(c) for c in raw.columns])
    return out


def read_school_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`{"items": [ {..}, .. ]}` -> one row per item, with its position."""
    item = T.ArrayType(schemas.text_schema(schemas.RAW["schools"]))
    body = spark.read.schema(T.StructType([T.StructField("items", item)])).option("multiLine", True).json(path)
    return body.select(F.posexplode("items").alias("_pos", "_item")).select("_pos", "_item.*").filter(
        F.coalesce(*[F.col(c) for c in schemas.RAW["schools"]]).isNotNull()
    )


def read_detail_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`{"items_by_plan_id": {"<id>": {..}}}` -> rows (plan_id, source_status, error_message, data)."""
    schema = f"items_by_plan_id map<string,{schemas.DETAIL_ENTRY}>"
    body = spark.read.schema(schema).option("multiLine", True).json(path)
    return detail_rows(body, F.col("items_by_plan_id"))


def detail_rows(df: DataFrame, entries: Column) -> DataFrame:
    out = df.select(F.explode(entries).alias("plan_key", "_entry"))
    return out.select(
        F.col("plan_key").alias("plan_id"), "_entry.source_status", "_entry.error_message", "_entry.data"
    )


def read_detail_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Detail records, one JSON object per line: (readable records, broken lines)."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter(F.trim("line") != "")
    parsed = lines.withColumn("_entry", F.from_json("line", schemas.DETAIL_ENTRY)).withColumn(
        "_ok", F.try_parse_json("line").isNotNull() & F.col("_entry.plan_id").isNotNull()
    )
    good = parsed.filter("_ok").select("_entry.*")
    return good, parsed.filter(~F.col("_ok")).select("line")


def latest_file(spark: SparkSession, patterns: list[str]) -> str:
    """Newest file of the first pattern that matches any (for example JSON first, then CSV)."""
    for pattern in patterns:
        try:
            files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
            newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        if newest is not None and newest["path"] is not None:
            return newest["path"]
    raise SourceError(f"no file matches {patterns}")


def declare_csv_table(spark: SparkSession, name: str, table: str, location: str) -> None:
    """External table over the cleaned CSV files, text columns, header skipped."""
    columns = ", ".join(f"`{c}` STRING" for c in schemas.CLEANED[table])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING csv "
        f"OPTIONS (header 'true', multiLine 'true', escape '\"', path '{location}')"
    )


def store_typed_table(spark: SparkSession, source: str, target: str, table: str, location: str, partition_by: str | None = None) -> None:
    """Parquet copy of a declared table with real types, as a table of the catalog; a filter on `partition_by` reads its folders only."""
    writer = typed(spark.table(source), table).write.mode("errorifexists").format("parquet").option("path", location)
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(target)


def national_lines(spark: SparkSession) -> DataFrame:
    """The fixed national lines. A subject line of 0 means there is none."""
    names = ["year", "major_category", "total_score_line", "politics_line", "english_line", "subject_one_line", "subject_two_line"]
    kinds = [T.StringType() if n == "major_category" else T.IntegerType() for n in names]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    subject = [F.nullif(F.col(n), F.lit(0)).alias(n) for n in names[3:]]
    return spark.createDataFrame(NATIONAL_LINES, schema).select(
        "year", F.lit("national").alias("line_type"), "major_category", "total_score_line", *subject,
        F.lit(0).alias("score_diff_to_national"),
    )


def rule_table(spark: SparkSession, rules: Rules = RULES) -> DataFrame:
    """The rule values as rows (name, value)."""
    plain = {k: float(v) for k, v in vars(rules).items() if isinstance(v, (int, float))}
    bonus = {f"level_bonus.{k}": float(v) for k, v in rules.level_bonus.items()}
    return spark.createDataFrame(sorted({**plain, **bonus}.items()), "name string, value double")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    return df


def union_ids(frames: list[DataFrame], column: str) -> DataFrame:
    """Distinct values of one column over several tables."""
    parts = [f.select(column) for f in frames]
    return reduce(DataFrame.unionByName, parts).filter(F.col(column) != "").distinct()
