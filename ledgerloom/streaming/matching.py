"""The external side of a match as a stream: files are matched as they come, what only the internal side has is known at the end.

Each micro-batch joins its rows with the internal index; a reference that an earlier row of the batch or an earlier batch had is a
duplicate. A batch writes its outcomes to a folder of its number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.streaming.common import folders, run_available


def match_batch(internal: DataFrame, external: DataFrame, seen: DataFrame | None, window_seconds: float = 120) -> DataFrame:
    """The outcomes of a batch of external rows; ``seen`` has the references of earlier batches."""
    if seen is None:
        fresh, again = external, external.limit(0)
    else:
        seen = seen.hint("shuffle_hash")  # held by share; repeated references do no harm
        fresh, again = external.join(seen, "reference", "left_anti").select(*external.columns), external.join(seen, "reference", "left_semi").select(*external.columns)
    # What has an external row is the batch's; internal rows without one are left to the end.
    out = reconcile.classify(internal, fresh, window_seconds).where("external is not null")
    repeats = reconcile.repeats(again, out)
    return out.unionByName(repeats)


def match_stream(spark: SparkSession, internal: DataFrame, source: str, work: str, window_seconds: float = 120, files_per_batch: int | None = None) -> DataFrame:
    """Drain ``source`` (Parquet files of canonical records with seq, in file order), close, and return all outcomes."""

    def batch(rows: DataFrame, number: int) -> None:
        done = [n for n in folders(spark, f"{work}/outcomes") if n < number]
        seen = spark.read.parquet(*[f"{work}/outcomes/{n}" for n in done]).select("reference") if done else None
        match_batch(internal, rows, seen, window_seconds).write.mode("overwrite").parquet(f"{work}/outcomes/{number}")

    run_available(spark, source, work, batch, files_per_batch=files_per_batch)
    done = spark.read.parquet(*[f"{work}/outcomes/{n}" for n in folders(spark, f"{work}/outcomes")])
    left = internal.join(done.select("reference").hint("shuffle_hash"), "reference", "left_anti").select(*internal.columns)
    return done.unionByName(reconcile.classify(left, spark.createDataFrame([], internal.schema), window_seconds))
