"""The outbox: what is due, how late it is, retries and dead letters, and the metrics panels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, LEASE_SECONDS, MAX_ATTEMPTS, MAX_BACKOFF_SECONDS = 64, 30, 8, 300


def waiting(outbox: DataFrame) -> DataFrame:
    return outbox.where("not published and not dead_letter")


def due(outbox: DataFrame, as_of: Column, n: int = BATCH) -> DataFrame:
    """The next ``n`` events to deliver: a top-k by (created_at, id), no full sort."""
    ready = waiting(outbox).where(F.coalesce(F.col("next_attempt_at") <= as_of, F.lit(True)))
    return ready.orderBy("created_at", "id").limit(n)


def claimed(outbox: DataFrame, as_of: Column, n: int = BATCH, lease: float = LEASE_SECONDS) -> DataFrame:
    """The outbox after a claim: the next ``n`` due events are hidden until their lease ends. Only ids are ranked, as a top-k."""
    until = F.timestamp_micros((F.unix_micros(as_of) + F.lit(round(lease * 1_000_000))).cast("long"))
    taken = F.broadcast(due(outbox, as_of, n).select("id").withColumn("_taken", F.lit(True)))
    rows = outbox.join(taken, "id", "left")
    return rows.withColumn("next_attempt_at", F.when(F.col("_taken"), until).otherwise(F.col("next_attempt_at"))).select(*outbox.columns)


def drained(outbox: DataFrame, handler: Callable[[DataFrame], DataFrame], path: str, as_of: Column, base: float, most: float = MAX_BACKOFF_SECONDS, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The outbox when nothing is left to deliver: each event is tried until it succeeds or has had ``attempts`` failures.

    ``handler`` takes waiting events and returns (id, ok). A round tries every waiting event once, at the time it is next
    due, and is a table below ``path``; there are at most ``attempts`` rounds, whatever the number of events.
    """
    spark = outbox.sparkSession
    left, done = outbox, []
    for i in range(attempts + 1):
        at = F.greatest(as_of, F.coalesce(F.col("next_attempt_at"), as_of))
        ready = waiting(left)
        tried = delivered(ready, handler(ready), at, base, most, attempts)
        done.append(left.where("published or dead_letter").select(*outbox.columns))
        tried.select(*outbox.columns).write.mode("overwrite").parquet(f"{path}/round-{i}")
        left = spark.read.schema(outbox.schema).parquet(f"{path}/round-{i}")
        if waiting(left).isEmpty():
            break
    done.append(left)
    return reduce(DataFrame.unionByName, done)


def lag_samples(outbox: DataFrame, times: DataFrame, at: str = "at") -> DataFrame:
    """(at, lag_seconds): at each time, the age of the oldest event created by then that still waits; 0 without one."""
    oldest = waiting(outbox).agg(F.min("created_at").alias("_oldest"))
    age = (F.unix_micros(at) - F.unix_micros("_oldest")) / F.lit(1_000_000.0)
    return times.join(F.broadcast(oldest)).select(at, F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)).alias("lag_seconds"))


def lag_seconds(outbox: DataFrame, as_of: Column) -> DataFrame:
    """The age of the oldest waiting event; 0 without one."""
    oldest = waiting(outbox).agg(F.min("created_at").alias("oldest"))
    age = (F.unix_micros(as_of) - F.unix_micros("oldest")) / F.lit(1_000_000.0)
    return oldest.select(F.coalesce(age, F.lit(0.0)).alias("lag_seconds"))


def dead_letters(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.count_if("dead_letter").alias("n"))


def backoff_seconds(attempt: Column, base: float, most: float = MAX_BACKOFF_SECONDS) -> Column:
    """base * 2 ** (attempt - 1), at most ``most``; a base of 0 never waits."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def delivered(outbox: DataFrame, results: DataFrame, as_of: Column, base: float, most: float = MAX_BACKOFF_SECONDS, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The outbox after deliveries: (id, ok). A success is published; a failure waits, or is dead after its last attempt."""
    rows = outbox.join(results.select("id", "ok"), "id", "left")
    tried = F.col("ok").isNotNull()
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    count = F.col("attempts") + F.when(failed, 1).otherwise(0)
    dead = failed & (count >= attempts)
    wait = F.timestamp_micros((F.unix_micros(as_of) + F.round(backoff_seconds(count, base, most) * 1_000_000)).cast("long"))
    return rows.select(
        *[c for c in outbox.columns if c not in ("published", "attempts", "next_attempt_at", "dead_letter")],
        (F.col("published") | (tried & F.coalesce("ok", F.lit(False)))).alias("published"),
        count.cast("int").alias("attempts"),
        F.when(failed & ~dead, wait).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        (F.col("dead_letter") | dead).alias("dead_letter"),
    )


def rate(events: DataFrame, ts: str = "ts", every: str = "1 minute", *by: str) -> DataFrame:
    """(start, by.., n, per_second) in tumbling windows: the counters' rates."""
    seconds = {"1 minute": 60, "5 minutes": 300, "1 hour": 3600}[every]
    counted = events.groupBy(F.window(ts, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def latency_quantile(rows: DataFrame, q: float = 0.99, ts: str = "ts", value: str = "latency_seconds", every: str = "5 minutes") -> DataFrame:
    """(start, n, quantile) per window, exact and interpolated."""
    out = rows.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, q).alias("quantile"))
    return out.select(F.col("w.start").alias("start"), "n", "quantile")


def histogram(rows: DataFrame, bounds: list[float], value: str = "latency_seconds") -> DataFrame:
    """(le, n): cumulative bucket counts, as a metrics endpoint shows them."""
    each = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.when(F.col(value) <= b, 1).otherwise(0).alias("hit")) for b in [*bounds, float("inf")]]))
    return rows.select(each.alias("b")).groupBy("b.le").agg(F.sum("b.hit").alias("n"))
