"""The transfer state machine over a stream of events: each batch folds its events onto the states so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lifecycle import legal
from ledgerloom.streaming.common import folders, run_available


def fold_batch(states: DataFrame | None, events: DataFrame) -> DataFrame:
    """(key, status, n_events) after a batch; an event that is not legal from where its key stands is a no-op."""
    steps = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "target"))).alias("_steps"))
    if states is None:
        joined = steps.select("key", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("n_events"), "_steps")
    else:
        joined = states.join(steps, "key", "full_outer").select("key", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("n_events", F.lit(0)).alias("n_events"), "_steps")
    none = F.array().cast("array<struct<ts:timestamp,event_id:bigint,target:string>>")
    steps_or_none = F.coalesce(F.col("_steps"), none)
    after = F.aggregate(F.transform(steps_or_none, lambda e: e["target"]), F.col("status"), lambda s, t: F.when(legal(s, t), t).otherwise(s))
    return joined.select("key", after.alias("status"), (F.col("n_events") + F.size(steps_or_none)).alias("n_events"))


def fold_stream(spark: SparkSession, source: str, work: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Drain ``source`` (Parquet files, in file order, that ``prepare`` turns into events) and return (key, status).

    A batch reads the latest states of its own keys and writes those alone; a key's last batch holds.
    """

    def latest(numbers: list[int]) -> DataFrame:
        written = spark.read.parquet(*[f"{work}/state/{n}" for n in numbers])
        return written.groupBy("key").agg(F.max_by("status", "batch").alias("status"), F.max_by("n_events", "batch").alias("n_events"))

    def batch(rows: DataFrame, number: int) -> None:
        done, events = [n for n in folders(spark, f"{work}/state") if n < number], prepare(rows)
        states = latest(done).join(events.select("key").distinct(), "key", "left_semi") if done else None
        fold_batch(states, events).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/state/{number}")

    run_available(spark, source, work, batch)
    return latest(folders(spark, f"{work}/state")).select("key", "status")
