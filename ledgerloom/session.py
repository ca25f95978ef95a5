"""The session settings that results depend on, and those that large inputs want."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI arithmetic (sums raise instead of wrapping) are part of the results' definition.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
TUNED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "ledgerloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (REQUIRED | TUNED | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
