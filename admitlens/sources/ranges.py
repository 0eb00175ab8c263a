"""CSV with line breaks inside quotes, read in ranges of a file instead of one task per file.

A line begins a record if the quotes before it, in its file, are even in number. A range knows its own quotes and how many records begin in
it for either parity; the sums over the ranges before it settle which one holds and number the records of every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.sources.stage import release, staged

_OPTIONS = {"quote": '"', "escape": '"', "header": "false"}


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record_no, record): the records of every file as text, numbered from 1 per file; blank lines are no records."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    lines = lines.withColumn("line", F.when(F.col("block") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")))
    quotes = F.length("line") - F.length(F.translate("line", '"', ""))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2
    held = staged(lines.withColumn("quotes", quotes).withColumn("odd", odd).withColumn("full", (F.trim("line") != "").cast("int")))

    begins = lambda parity: F.sum(F.when(F.col("odd") == parity, F.col("full")).otherwise(0))
    blocks = held.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("quotes"), begins(0).alias("even_begins"), begins(1).alias("odd_begins"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    known = blocks.withColumn("parity", parity).withColumn("n", F.when(F.col("parity") == 0, F.col("even_begins")).otherwise(F.col("odd_begins")))
    starts = known.select("file", "block", "parity", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    joined = held.join(starts, ["file", "block"])
    begin = F.when(F.col("odd") == F.col("parity"), F.col("full")).otherwise(0)
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = joined.withColumn("open", F.col("odd") != F.col("parity")).withColumn("record_no", F.col("before") + F.sum(begin).over(upto))
    kept = numbered.filter(F.col("open") | (F.col("full") == 1))
    whole = kept.groupBy("file", "record_no").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
    return whole.select("file", "record_no", F.array_join(F.col("parts.line"), "\n").alias("record"))


def read_csv_ranges(spark: SparkSession, path: str | list[str], line: str = "_line_no") -> DataFrame:
    """Headered CSV as text columns, "" = NULL, with the record's number in its file (the first behind the header is 2).

    All files have the columns of the first one's header, which comes to the driver. No row for no records.
    """
    records = staged(csv_records(spark, path))
    head = records.filter("record_no = 1").orderBy("file").first()
    if head is None:
        release(records)
        return spark.createDataFrame([], f"{line} long")
    any_columns = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(head.record.count(",") + 1)])
    names = [n for n in spark.range(1).select(F.from_csv(F.lit(head.record), any_columns.simpleString()[7:-1].replace(":", " "), _OPTIONS).alias("h")).first().h if n is not None]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = records.filter("record_no > 1").select(F.col("record_no").alias(line), F.from_csv("record", schema, _OPTIONS).alias("r"))
    return rows.select(*[F.nullif(F.col(f"r.`{n}`"), F.lit("")).alias(n) for n in names], line)
