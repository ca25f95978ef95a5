"""The outbox as a stream: deliver what waits, count failures, set dead letters apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import outbox
from ledgerloom.streaming.common import folders, run_available

#: A handler takes due events and returns (id, ok). It must be idempotent: a batch may be delivered again.
Handler = Callable[[DataFrame], DataFrame]


def even_ids(events: DataFrame) -> DataFrame:
    return events.select("id", (F.col("id") % 2 == 0).alias("ok"))


def deliver_batch(events: DataFrame, handler: Handler, as_of, base: float = 0.5) -> DataFrame:
    """The batch's outbox rows after one attempt for each that waits. An event delivered twice in a batch counts once."""
    waiting = outbox.waiting(events).dropDuplicates(["id"])
    return outbox.delivered(waiting, handler(waiting), as_of, base)


def deliver_stream(spark: SparkSession, source: str, work: str, handler: Handler = even_ids, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, base: float = 0.5) -> DataFrame:
    """Drain ``source``, whose rows ``prepare`` turns into outbox rows, and return the events tried; dead letters are also in ``<work>/dead``.

    A failed event is tried again, each time at the end of its backoff, until it succeeds or is dead (``outbox.drained``).
    """

    def batch(rows: DataFrame, number: int) -> None:
        waiting = outbox.waiting(prepare(rows)).dropDuplicates(["id"])
        done = outbox.drained(waiting, handler, f"{work}/rounds/{number}", F.current_timestamp(), base)
        done.write.mode("overwrite").parquet(f"{work}/attempted/{number}")
        spark.read.parquet(f"{work}/attempted/{number}").where("dead_letter").write.mode("overwrite").parquet(f"{work}/dead/{number}")

    run_available(spark, source, work, batch)
    return spark.read.parquet(*[f"{work}/attempted/{n}" for n in folders(spark, f"{work}/attempted")])
