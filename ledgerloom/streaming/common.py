"""Draining a file stream into numbered folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folders(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose folder is complete."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(x.getName()) for x in names if x.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def run_available(spark: SparkSession, source: str, work: str, batch: Callable[[DataFrame, int], None], prepare: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append", files_per_batch: int | None = None) -> None:
    """Run a query over all files that are there, resuming after the last finished batch, and stop."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(f"{source[:-1]}[{source[-1]}]")  # as a pattern, it may be one file as well as a folder
    rows = prepare(rows) if prepare else rows
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
