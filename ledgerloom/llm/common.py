"""What several operators need: shared scratch tables, ranks without a hot task, components."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets among which the rows of one key are dealt when they are ranked.
RANK_BUCKETS = 512
#: Rows of a bucket at most, on average, when a large table is ranked.
RANK_ROWS = 1 << 20
#: Buckets of ids that a filter of candidates has: what is broadcast is bounded by it.
FILTER_BUCKETS = 1 << 20
#: UTF-8 bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 1 << 21


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in local mode may it be unset; then it is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints"))
            root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/ledgerloom"


#: Scratches with tables that a result may still read.
_open: set[Scratch] = set()


class Scratch:
    """Tables written to the shared folder, which cut the lineage and outlive any executor.

    A table is computed once (``checkpoint()`` would compute its last stage twice) and is
    dropped as soon as a later one replaces it; those that an operator's lazy result reads stay until ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        _open.add(self)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                self._delete(path)

    def keep(self, *names: str) -> None:
        """Drop all tables but those that the result still reads."""
        self.drop(*[n for n in self.paths if n not in names])

    def close(self) -> None:
        """Drop everything; results that read from here are no longer of use."""
        self.paths.clear()
        self._delete(self.root)
        _open.discard(self)

    def _delete(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def release(self) -> None:
        """Let go of finished steps' shuffle files, which stay on disk until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """What operators leave in the shared folder inside the block goes at its end, when its results are in tables of their own."""
    before = set(_open)
    try:
        yield
    finally:
        for s in [s for s in _open if s not in before]:
            s.close()


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, alias: str = "row") -> Column:
    """All columns, whatever their names, as one struct."""
    return F.struct(*[named(c) for c in df.columns]).alias(alias)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each of at most ``limit`` bytes of text (or of one row)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def listed_apart(rows: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in ``listed``, rows whose key may be), by a filter of buckets that is broadcast.

    ``listed`` is a saved table. The filter has at most FILTER_BUCKETS rows whatever the tables' sizes; nothing is shuffled.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(FILTER_BUCKETS)).cast("int").alias("_b")
    filled = F.broadcast(listed.select(bucket).distinct())
    dealt = rows.withColumn("_b", bucket)
    return dealt.join(filled, "_b", "left_anti").drop("_b"), dealt.join(filled, "_b", "left_semi").drop("_b")


def only_listed(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is in the saved table ``ids``. Of the wide rows that are not listed few move."""
    return listed_apart(rows, ids, key)[1].join(ids, key, "left_semi")


def in_tiles(rows: DataFrame, key: Sequence[str], spread: Column, most: int, payload: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """``rows`` dealt into tiles for ``tile_pairs``: a key with more than ``most`` rows is split by hash.

    Adds part, low and high. Each row goes to the tile of every pair (low, high) of parts that has its
    own, so any two rows of a key meet in one tile, and a tile holds about twice ``most`` rows at most.
    Keys are counted with partial counts, so a hot one is gathered nowhere; ``rows`` is read twice.
    Wide columns come from ``payload``, joined ``on`` its key when the rows' tiles are known, so that they move once.
    """
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    counted = rows.join(counts.withColumn("_parts", F.ceil(F.col("_n") / most).cast("int")).drop("_n"), list(key)).withColumn("part", F.pmod(spread, F.col("_parts")).cast("int"))
    dealt = counted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("low", F.least("part", "_other")).withColumn("high", F.greatest("part", "_other")).drop("_other", "_parts")
    if payload is not None:
        dealt = dealt.join(payload, list(on))
    return by_tile(dealt, key)


def by_tile(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    tile = [*key, "low", "high"]
    return rows.repartition(*[F.col(c) for c in tile]).sortWithinPartitions(*tile)


def tile_pairs(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[pa.Table, pa.Table | None]]:
    """Of sorted tiles: (rows, None) whose rows are to be compared with each other, or (rows, other rows)."""
    names, held = [*key, "low", "high"], None

    def cut(table: pa.Table) -> list[pa.Table]:
        change = np.zeros(len(table), bool)
        for c in names:
            x = table.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        ends = [*np.flatnonzero(change).tolist(), len(table)]
        return [table.slice(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def whole(found: list[pa.Table]) -> Iterator[tuple[pa.Table, pa.Table | None]]:
        for g in found:
            if len(g) > 1:
                low = g.column("low")[0].as_py()
                if low == g.column("high")[0].as_py():
                    yield g, None
                    continue
                side = g.column("part").to_numpy() == low
                if side.any() and not side.all():
                    yield g.filter(pa.array(side)), g.filter(pa.array(~side))

    for batch in batches:
        if len(batch):
            table = pa.Table.from_batches([batch])
            found = cut(pa.concat_tables([held, table]) if held is not None else table)
            held = found.pop()
            yield from whole(found)
    if held is not None:
        yield from whole([held])


def rank_buckets(n: int) -> int:
    """Buckets for ranking ``n`` rows: RANK_BUCKETS, and more where a bucket of a hot key would exceed RANK_ROWS rows."""
    return max(RANK_BUCKETS, 1 << (n // RANK_ROWS).bit_length())


def dealt_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread: Column, out: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """``df`` with ``out``: a gapless position from 0 among the rows of equal ``keys``.

    Rows are ordered by ``pmod(spread, buckets)`` and then by ``order``. Only a bucket's rows meet in
    a task, so a key with a third of all rows is ranked by up to ``buckets`` tasks; the buckets' sizes
    are summed on their own (at most ``buckets`` rows a key). Keys and spread must not be null.
    """
    bucket = F.pmod(spread, F.lit(buckets)).cast("int")
    held = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = held.withColumn("_in", F.row_number().over(inside))
    return ranked.join(starts, [*keys, "_bucket"]).withColumn(out, F.col("_start") + F.col("_in") - 1).drop("_bucket", "_in", "_start")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node that reaches a smaller one over links: root is the smallest. Roots have no row.

    ``edges`` has the columns u and v. The graph is contracted round by round: each node points to the first of
    its neighbours and itself, and links go on between what their ends point to, without loops and repeats. The
    order is by id in even rounds, so a star is one node after one round, and by a hash of the round in odd ones, so
    that of any graph, a sorted path too, a share of the nodes goes: rounds shrink geometrically, and all of them
    together cost about as much as the first. Then the pointers are followed back, last round first, and each group's smallest node is its root.
    Every step is a partially aggregated minimum or a join, so no group is gathered, and every round is a
    table in the shared folder, so a lost executor costs one round at most. Inputs of every size go this way.
    """
    given = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    left, points, i = scratch.save(f"{name}-links-0", given.distinct()), [], 0
    while not left.isEmpty():
        if i == most_rounds:
            raise RuntimeError(f"components: still links after {most_rounds} rounds")
        near = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if i % 2:
            first = lambda c, i=i: F.struct(F.xxhash64(c, F.lit(i)).alias("h"), F.col(c).alias("x"))
            to = F.least(first("u"), F.min(first("v")))["x"]
        else:
            to = F.least("u", F.min("v"))
        point = scratch.save(f"{name}-points-{i}", near.groupBy("u").agg(to.alias("to")).select(F.col("u").alias("node"), "to"))
        points.append(point)
        ends = left.join(point.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(point.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        i += 1
        left = scratch.save(f"{name}-links-{i}", ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        scratch.drop(f"{name}-links-{i - 1}")
    if not points:
        scratch.drop(f"{name}-links-0")
        return scratch.save(f"{name}-roots", given.limit(0).select(F.col("u").alias("node"), F.col("v").alias("root")))
    ends = points.pop().select("node", F.col("to").alias("end"))
    for k, point in enumerate(reversed(points)):
        ends = point.join(ends.select(F.col("node").alias("to"), "end"), "to", "left").select("node", F.coalesce("end", "to").alias("end"))
        if k % 8 == 7:
            ends = scratch.save(f"{name}-ends-{k}", ends)
    ends = scratch.save(f"{name}-ends", ends)
    lowest = ends.groupBy("end").agg(F.min("node").alias("root"))
    roots = scratch.save(f"{name}-roots", ends.join(lowest, "end").where("node <> root").select("node", "root"))
    scratch.drop(*[x for x in scratch.paths if x.startswith(f"{name}-") and x != f"{name}-roots"])
    return roots
