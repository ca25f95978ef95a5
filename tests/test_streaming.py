from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle, outbox
from ledgerloom.plans import tables
from ledgerloom.streaming.common import run_available
from ledgerloom.streaming.delivery import deliver_stream
from ledgerloom.streaming.machine import fold_batch, fold_stream


def log(spark, n=400):
    kinds = F.array(*[F.lit(x) for x in ("view", "click", "error", "purchase", "signup")])
    i = F.col("id")
    return spark.range(n).select(i.alias("event_id"), F.timestamp_seconds(1_700_000_000 + i * 60).cast("timestamp_ntz").alias("ts"), (i % 7).alias("user_id"), F.element_at(kinds, (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))


def test_stream_in_many_batches_equals_one_fold(spark, tmp_path):
    rows = log(spark)
    source = f"{tmp_path}/events.parquet"
    rows.where("event_id < 150").coalesce(1).write.parquet(source)
    first = fold_stream(spark, source, f"{tmp_path}/work", tables.as_events)
    assert first.count() > 0
    rows.where("event_id >= 150").coalesce(1).write.mode("append").parquet(source)
    got = fold_stream(spark, source, f"{tmp_path}/work", tables.as_events)  # resumes after the first batch
    want = lifecycle.fold_events(tables.as_events(rows)).select("key", "status")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    events = tables.as_events(log(spark, 100))
    one = fold_batch(None, events.where("event_id < 50"))
    a, b = (fold_batch(one, events.where("event_id >= 50")).collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_delivery_and_dead_letters(spark, tmp_path):
    source = f"{tmp_path}/events.parquet"
    log(spark).write.parquet(source)
    got = deliver_stream(spark, source, f"{tmp_path}/work", prepare=tables.as_outbox)
    waiting = outbox.waiting(tables.as_outbox(log(spark)))
    assert got.count() == waiting.count()
    assert got.where("published").count() == waiting.where("id % 2 = 0").count()
    dead = spark.read.parquet(f"{tmp_path}/work/dead/0")
    assert dead.count() == waiting.where("id % 2 = 1").count() > 0  # tried until the last attempt
    assert got.where("not published").agg(F.min("attempts"), F.max("attempts")).first() == (8, 8)


def test_backoff(spark):
    rows = spark.range(1, 12).select(outbox.backoff_seconds(F.col("id"), 0.5).alias("a"), outbox.backoff_seconds(F.col("id"), 0).alias("b")).collect()
    assert [r["a"] for r in rows] == [min(300.0, 0.5 * 2 ** (n - 1)) for n in range(1, 12)] and {r["b"] for r in rows} == {0.0}


def test_draining_twice_reads_nothing_new(spark, tmp_path):
    source = f"{tmp_path}/events.parquet"
    log(spark, 10).write.parquet(source)
    seen = []
    for _ in range(2):
        run_available(spark, source, f"{tmp_path}/work", lambda rows, n: seen.append((n, rows.count())))
    assert seen == [(0, 10)]
