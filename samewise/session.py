"""The Spark session of tests, benches and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session, unless spark-submit or the environment names a master or a session runs already."""
    builder = SparkSession.builder.appName("samewise")
    named = "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or any(x in os.environ for x in ("SPARK_MASTER", "MASTER", "SPARK_REMOTE"))
    if not named and SparkSession.getActiveSession() is None:
        n = cpus or os.cpu_count() or 1
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", "12g")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
