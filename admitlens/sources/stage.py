"""Intermediate results written once and read back, so that several outputs do not recompute them.

They go to the shared folder the session names in `spark.checkpoint.dir`, or the context's checkpoint folder, or below the
warehouse where both are unset; any executor can read them again after another one is lost. `release` removes a table that is no
longer read; what is left goes when the application ends. The shuffle files of such a write have served when it ends, and go then.
Code generated for a whole stage is given up where the JVM would interpret it because a method is too long; smaller pieces are compiled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Settings of a staged write, put back after it. HotSpot compiles no method of more than 8,000 bytes.
_OF_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


def stage_folder(spark: SparkSession) -> str:
    """The shared folder of this session: its setting, else the context's checkpoint folder, else below the warehouse."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def _write_settings(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files. Each run of a frame plans its own shuffles, so no other query reads them."""
    before = {k: spark.conf.get(k, None) for k in _OF_WRITE}
    for k, v in _OF_WRITE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet and return a scan of them."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/admitlens/{spark.sparkContext.applicationId}/{uuid4().hex}"
    with _write_settings(spark):
        df.write.mode("errorifexists").parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    scan = spark.read.schema(df.schema).parquet(path)
    scan.staged_path = path
    return scan


def release(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more (not the ones behind a frame still to be used)."""
    for df in frames:
        files, place = _file_system(df.sparkSession, df.staged_path)
        files.delete(place, True)
