"""Sharding by balanced label propagation: copies of a text are drawn to one shard, row counts stay even.

The law is ``rows``: shards' counts are at most one apart. Documents of equal text are linked. They
start in the shard of their key's hash; in each round the groups that have no home yet vote for the shard
where most of their documents are, among those that have room for the whole group. A shard takes groups, large ones
first and then in hashed order, as far as its quota of rows allows. Only groups at home count against a quota: the documents
of others are about to leave, so whatever they hold is room. Rounds go on until one takes nothing, that is, until
every group is at home or larger than the room left in any shard. Documents of such groups and those without links are
dealt last, the groups' one after another, so they fill every shard to its quota exactly.

Groups of more than a sixteenth of the smallest quota are few (some 16 a shard at most), so the driver finds their homes
before the rounds, the largest first, from their counts by shard: where most of a group's documents are among the shards with room
for all of it. Only a group larger than any room left is cut: it fills the largest room, and the rest goes on as a group of its size,
so a group larger than a quota fills shards whole, and its rest has nothing to gain from their votes as they are full.

Rounds work on the groups' counts by shard, never on rows or texts; what the driver sees are the shards' sums and
the large groups' counts. Each round is a table in the shared folder.

Results for odd input: null text counts 0 bytes, has checksum 0 and is linked as empty text; rows with
null or repeated keys are placed like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, dealt_rank, rank_buckets

SHARDS, POOL_BUCKETS, VOTE_BUCKETS = 24, 2048, 64
#: A group of more than this part of a quota finds its home on the driver.
LARGE = 16


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (shard + 1).cast("int"))


def _votes(shards: int) -> Column:
    """How many rows each shard has, as an array."""
    return F.array(*[F.count(F.when(F.col("shard") == k, 1)) for k in range(shards)])


def _taken(units: DataFrame, room: list[int], salt: int) -> DataFrame:
    """(g, n, votes, target) of ``units`` (g, n, votes): target is the shard that takes the group, null if none does."""

    def wish(k: int) -> Column:
        # Among shards without a vote the chance is in proportion to the room.
        chance = (F.pmod(F.xxhash64("g", F.lit(salt), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.when(F.col("n") <= room[k], F.struct(F.col("votes")[k].alias("n"), (F.log(chance) / float(max(room[k], 1))).alias("chance"), F.lit(k).alias("k")))

    asked = units.withColumn("wish", F.array_max(F.array(*[wish(k) for k in range(len(room))]))["k"])
    order = F.xxhash64("g", F.lit(salt))
    asked = asked.withColumn("bucket", (F.lit(64) - F.floor(F.log2("n"))) * VOTE_BUCKETS + F.pmod(order, F.lit(VOTE_BUCKETS)))
    before = Window.partitionBy("wish").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = asked.groupBy("wish", "bucket").agg(F.sum("n").alias("b")).select("wish", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("wish", "bucket").orderBy(F.desc("n"), order, "g").rowsBetween(Window.unboundedPreceding, 0)
    upto = asked.withColumn("upto", F.sum("n").over(inside)).join(starts, ["wish", "bucket"], "left")
    return upto.select("g", "n", "votes", F.when(F.col("start") + F.col("upto") <= _by_shard(room, F.col("wish")), F.col("wish")).alias("target"))


def _packed(groups: list[tuple[bytes, int, list[int]]], quotas: list[int]) -> tuple[list[tuple[bytes, int, int, int]], list[int]]:
    """([(g, from, to, shard)] of groups (g, n, votes): the places of a group's rows that a shard takes, the room left)."""
    room, out = list(quotas), []
    queue = [(-n, g, 0, votes) for g, n, votes in groups]
    heapq.heapify(queue)
    while queue:
        n, g, start, votes = heapq.heappop(queue)
        n = -n
        k = max(range(len(room)), key=lambda k: (min(room[k], n), votes[k], -k))
        took = min(room[k], n)
        out.append((g, start, start + took, k))
        room[k] -= took
        if took < n:
            heapq.heappush(queue, (took - n, g, start + took, votes))
    return out, room


def _homes(units: DataFrame, room: list[int], scratch: Scratch) -> tuple[DataFrame, DataFrame, list[int]]:
    """((g, shard) of the groups at home, those larger than the room left in any shard, the room left)."""
    room, homes, left, i = list(room), units.select("g", F.lit(0).alias("shard")).limit(0), units, 0
    while True:
        i += 1
        asked = scratch.save(f"asked-{i}", _taken(left, room, i))
        got = asked.where("target is not null").groupBy("target").agg(F.sum("n").alias("n")).collect()
        if not got:
            return homes, left, room
        for r in got:
            room[r["target"]] -= r["n"]
        homes = homes.unionByName(asked.where("target is not null").select("g", F.col("target").alias("shard")))
        left = asked.where("target is null").drop("target")


def cut_edges(sharded: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (links, cut): links of a chain through each group of equal texts, and those among them that cross shards at the least.

    ``key`` is taken to be unique. A group in k shards cuts at least k - 1 links.
    """
    groups = docs.select(F.col(key).alias("_k"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_g"))
    each = sharded.join(groups, F.col(key) == F.col("_k")).groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("k"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("cut"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    raw = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("crc"), F.unhex(F.md5(raw.cast("binary"))).alias("g"))
    base = scratch.save("base", base.withColumn("h", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "g")))
    groups = scratch.save("groups", base.groupBy("g").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    total = base.count()
    quotas = _quotas(total, shards)
    large = F.col("copies") * LARGE > min(quotas)

    columns = ["id", "size", "crc", "g", "h"]
    rows = scratch.save("rows", base.join(groups, "g").select(*columns, "copies", F.pmod("h", F.lit(shards)).cast("int").alias("shard")))
    votes = scratch.save("votes", rows.groupBy("g", "copies").agg(_votes(shards).alias("votes")))
    parts, room = _packed([(bytes(r["g"]), r["copies"], r["votes"]) for r in votes.where(large).collect()], quotas)
    homes, left, room = _homes(votes.where(~large).select("g", F.col("copies").alias("n"), "votes"), room, scratch)

    rows = rows.drop("shard")
    placed = rows.where(~large).join(homes, "g").select(*columns, "shard")
    if parts:
        sent = F.broadcast(docs.sparkSession.createDataFrame(parts, "g binary, start long, end long, shard int"))
        ranked = dealt_rank(rows.where(large), ["g"], [F.col("h"), F.col("id")], F.col("h"), "place", rank_buckets(total))
        placed = placed.unionByName(ranked.join(sent, "g").where("place >= start and place < end").select(*columns, "shard"))
    # What found no home is dealt first, to the largest rooms, a group's rows one after another.
    first = rows.where(~large).join(left.select("g"), "g").select(*columns, F.lit(0).alias("turn"), F.xxhash64("g").alias("by"))
    pool = first.unionByName(base.join(groups, "g", "left_anti").select(*columns, F.lit(1).alias("turn"), F.col("h").alias("by")))
    ahead = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = dealt_rank(pool, ["turn"], [F.col("by"), F.col("h"), F.col("g"), F.col("id")], F.col("by"), "place", max(POOL_BUCKETS, rank_buckets(total))).withColumn("place", F.col("place") + F.col("turn") * ahead)
    roomy = sorted(range(shards), key=lambda k: -room[k])
    ends = list(accumulate(room[k] for k in roomy))
    turn = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("place")))
    dealt = dealt.withColumn("shard", _by_shard(roomy, turn).cast("int"))
    done = scratch.save("done", placed.unionByName(dealt.select(*columns, "shard")))
    out = dealt_rank(done, ["shard"], [F.col("h"), F.col("g"), F.col("id")], F.col("h"), "slot", rank_buckets(total // shards))
    scratch.keep("done")
    return out.select(F.col("id").alias(key), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
