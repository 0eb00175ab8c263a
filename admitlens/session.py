"""Session builder used by tests and the benchmark.

Library code never reads these settings: every operator takes the DataFrames it
works on and behaves the same on a session somebody else built.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "admitlens", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster use the session the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="admitlens-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.debug.maxToStringFields", "200")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
