import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import Scratch, components, dealt_rank, only_listed, rank_buckets, scratch_root, scratch_scope
from tests.llm.helpers import rows


def plain(edges):
    low = {}

    def root(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            low[max(a, b)] = min(a, b)
    return sorted(((x, root(x)) for x in low if root(x) != x), key=str)


GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "shuffled path": [(a, b) for a, b in zip(random.Random(1).sample(range(60), 60), random.Random(1).sample(range(60), 60)[1:], strict=False)],
    "star": [(7, i) for i in range(50)],
    "random": [(random.Random(2).randrange(10**12) % 90, random.Random(i).randrange(90)) for i in range(60)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3)],
    "none": [],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_components(spark, name):
    edges, scratch = spark.createDataFrame(GRAPHS[name], "u long, v long"), Scratch(spark)
    assert rows(components(edges, scratch)) == plain(GRAPHS[name])
    assert list(scratch.paths) == ["cc-roots"]


def test_only_listed(spark):
    wide = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text"))
    ids = spark.range(3, 500, 50)
    assert rows(only_listed(wide, ids)) == sorted(((i, f"t{i}") for i in range(3, 500, 50)), key=str)
    assert only_listed(wide, ids.limit(0)).isEmpty()


def test_scope_leaves_nothing(spark):
    import os

    with scratch_scope():
        s = Scratch(spark)
        s.save("x", spark.range(3).toDF("x"))
        assert os.path.isdir(f"{s.root}/x")
    assert not os.path.exists(s.root)


def test_rank_buckets_grow():
    assert rank_buckets(10) == rank_buckets(10**8) == 512 and 10**12 / rank_buckets(10**12) <= common.RANK_ROWS


def test_dealt_rank_is_gapless(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    got = dealt_rank(df, ["key"], [F.col("id")], F.xxhash64("id"), "place", 16).collect()
    places = defaultdict(list)
    for r in got:
        places[r["key"]].append(r["place"])
    assert len(got) == 1000 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert Counter(r["key"] for r in got)["hot"] == 334


def test_scratch_is_in_the_folder_that_the_session_names(spark):
    root = scratch_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    s = Scratch(spark)
    df = s.save("x", spark.range(3).toDF("x"))
    assert df.count() == 3 and df.inputFiles()[0].split("file://")[-1].startswith(root)
    s.drop("x", "never was")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file|FILE_NOT_EXIST"):
        spark.read.parquet(f"{s.root}/x").count()
