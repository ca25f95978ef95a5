"""Rates over tumbling windows of a stream, with a watermark that bounds the windows held as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.streaming.common import folders, run_available


def rate_stream(spark: SparkSession, source: str, work: str, every: str = "1 hour", late: str = "400 days", prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(start, event_type, n): every batch writes the windows it changed, and the last count of a window holds."""

    def counted(rows: DataFrame) -> DataFrame:
        events = prepare(rows).withWatermark("ts", late)
        return events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/counts/{number}")

    run_available(spark, source, work, batch, counted, "update")
    written = spark.read.parquet(*[f"{work}/counts/{n}" for n in folders(spark, f"{work}/counts")])
    return written.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
