"""How many partitions a shuffle of large tables needs, so that a task's share stays the same as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files a partition; rows in memory take some twenty times as much.
SHARE = 6_000_000


def input_bytes(*tables: DataFrame) -> int:
    """The size of the files under some tables, as Spark's plan knows it; rows that come from no file count nothing."""
    total = 0
    for table in tables:
        leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        total += sum(s for s in sizes if s < 1 << 62)  # Spark's word for unknown
    return total


def partitions(*tables: DataFrame) -> int:
    """For ``repartition(n, key)``: by the input's size, at least one a core.

    Adaptive execution leaves these partitions alone. Its own are merged by their compressed size, and rows like these ones
    compress so well that a task then sorts some thirty times as much.
    """
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-input_bytes(*tables) // SHARE))
