"""Mixing sources to target weights by Pfair scheduling.

Documents are dealt, in the order of a hash, into blocks of their source's stream. Block j of a
stream of weight p out of Q is released at slot floor(j Q / p) and due by slot ceil((j + 1) Q / p);
one block runs in each slot, of those released the one due first. So after t slots a stream has run
less than one block more or less than t p / Q.

The schedule repeats every Q slots, so one period of each phase is all that is computed on the driver:
integer weights keep Q small, and streams are the sources that the weights name; all others (and null)
are one stream, ``OTHER``. When a stream runs out, the phase ends and the others go on with their
weights' shares of what is left. Every document is in the mix exactly once.

Results for odd input: a null key or text is a row like any other; a repeated row has a place of
its own (equal keys, null ones too, are spread and ordered by the columns given in ``ties``); an empty table gives no rows; a source of weight 0
comes last; other columns are kept, whatever their names. Weights are non-negative integers, at most ``MOST`` streams and slots a period.
"""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt_rank, named, rank_buckets, whole_row

OTHER = "*"
#: Rows of a block, streams at most, slots of a period at most: the driver's work and what is broadcast is bounded by these.
BLOCK, MOST, MOST_SLOTS = 32, 256, 1 << 14
#: The mix of the registered query and the pipeline: two named large sources, less of the rest each.
TARGETS = {"src0": 20, "src1": 10, "src2": 10, "src3": 6, "src4": 6, **{f"src{i}": 3 for i in range(5, 20)}, OTHER: 3}


def period(weights: dict[str, int]) -> list[str]:
    """The streams that run in each of the sum(weights) slots of a period, earliest deadline first."""
    total = sum(weights.values())
    waiting = [(0, -(-total // p), s, 0) for s, p in weights.items() if p]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        assert slot < due, "weights that sum to the period always meet their deadlines"
        out.append(s)
        j += 1
        p = weights[s]
        heapq.heappush(waiting, (j * total // p, -(-(j + 1) * total // p), s, j))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """From each stream's blocks: for each phase its first slot, its weights and period, and each stream's first block and count."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        live = {s: weights.get(s, 0) for s in left}
        if not any(live.values()):
            live = dict.fromkeys(left, 1)
        live = {s: p for s, p in live.items() if p}
        slots = period(live)
        total = len(slots)
        places: dict[str, list[int]] = {s: [] for s in live}
        for i, s in enumerate(slots):
            places[s].append(i)
        # The phase lasts until the first slot that wants a block of a stream that has none.
        end = min((left[s] // p) * total + places[s][left[s] % p] for s, p in live.items())
        runs = {s: (end // total) * p + sum(i < end % total for i in places[s]) for s, p in live.items()}
        if end:
            out.append({"start": start, "slots": end, "total": total, "weights": live, "places": places, "first": {s: done[s] for s in live}, "runs": runs})
        start += end
        for s, n in runs.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out


def mixed(docs: DataFrame, weights: dict[str, int], block: int = BLOCK, key: str = "doc_id", source: str = "source", ties: tuple[str, ...] = ("source",)) -> DataFrame:
    """(row, _stream, _block, _release, _due (slots of the phase), _phase, _slot (of the whole mix), _offset (in the block)): row is the whole row of ``docs``.

    Ordered by (_slot, _offset) the rows are the mix. Rows are ranked in two steps, so no source meets
    in one task; the streams' sizes are the only thing collected.
    """
    if len(weights) > MOST or sum(weights.values()) > MOST_SLOTS or any(p < 0 or p != int(p) for p in weights.values()):
        raise ValueError(f"weights are at most {MOST} non-negative integers of a sum of at most {MOST_SLOTS}")
    known = [s for s in weights if s != OTHER]
    stream = F.when(named(source).isin(known), named(source)).otherwise(F.lit(OTHER)) if known else F.lit(OTHER)
    # The rows' own columns are out of the way in a struct, so theirs and the schedule's names don't clash.
    rows = docs.select(whole_row(docs), stream.alias("_stream"))
    sizes = {r["_stream"]: r["n"] for r in rows.groupBy("_stream").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = phases({s: ceil(n / block) for s, n in sizes.items()}, weights)

    table, pattern = [], []
    for k, ph in enumerate(plan):
        for s, p in ph["weights"].items():
            if ph["runs"][s]:
                table.append((s, k, ph["first"][s], ph["first"][s] + ph["runs"][s], ph["start"], ph["total"], p))
                pattern += [(s, k, i, at) for i, at in enumerate(ph["places"][s])]
    spark = docs.sparkSession
    runs = spark.createDataFrame(table, "_stream string, _phase int, _first long, _end long, _start long, _total long, _weight long")
    places = spark.createDataFrame(pattern, "_stream string, _phase int, _nth long, _at long")

    own = [F.col("row")[c] for c in (key, *ties)]
    spread = F.xxhash64(F.coalesce(own[0].cast("string"), F.lit("")), *own[1:])
    ranked = dealt_rank(rows.withColumn("_spread", spread), ["_stream"], [F.col("_spread"), *own], F.col("_spread"), "_rank", rank_buckets(sum(sizes.values()))).drop("_spread")
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_offset", (F.col("_rank") % block).cast("int")).drop("_rank")
    # Both tables are bounded by MOST streams and their periods, not by the data.
    joined = ranked.join(F.broadcast(runs.withColumnRenamed("_stream", "_s")), (F.col("_stream") == F.col("_s")) & (F.col("_block") >= F.col("_first")) & (F.col("_block") < F.col("_end"))).drop("_s")
    joined = joined.withColumn("_j", F.col("_block") - F.col("_first")).withColumn("_nth", F.col("_j") % F.col("_weight"))
    joined = joined.join(F.broadcast(places), ["_stream", "_phase", "_nth"])
    slot = F.col("_start") + F.floor(F.col("_j") / F.col("_weight")) * F.col("_total") + F.col("_at")
    return (
        joined.withColumn("_slot", slot)
        .withColumn("_release", F.floor(F.col("_j") * F.col("_total") / F.col("_weight")))
        .withColumn("_due", F.ceil((F.col("_j") + 1) * F.col("_total") / F.col("_weight")))
        .drop("_j", "_nth", "_at", "_first", "_end", "_start", "_total", "_weight")
    )


def mix_places(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, stream, block, release, due, phase, slot, block_offset) of every row."""
    slim = docs.select(named(key).alias("key"), named(source).alias("source"), F.xxhash64(named(text)).alias("tie")) if text in docs.columns else docs.select(named(key).alias("key"), named(source).alias("source"), F.lit(0).alias("tie"))
    rows = mixed(slim, TARGETS if weights is None else weights, block, "key", "source", ("source", "tie"))
    return rows.select(F.col("row.key").alias(key), F.col("row.source").alias(source), F.col("_stream").alias("stream"), F.col("_block").cast("long").alias("block"), F.col("_release").cast("long").alias("release"), F.col("_due").cast("long").alias("due"), F.col("_phase").alias("phase"), F.col("_slot").cast("long").alias("slot"), F.col("_offset").alias("block_offset"))
