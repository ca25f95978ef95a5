import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm.sharding import balanced_shards, cut_edges
from tests.llm.helpers import DOCS, clashing, docs, rows


def check(got, given, shards):
    """The law of rows, gapless slots, and sizes and checksums by plain Python."""
    assert len(got) == len(given)
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    each = [counts.get(k, 0) for k in range(shards)]
    assert max(each) - min(each) <= 1 and sum(each) == len(given)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_come_together_and_counts_stay_even(spark, seed):
    r = random.Random(seed)
    texts = [f"text {i}" for i in range(40)] + [None, ""]
    given = [(i, r.choice(texts[:6] + texts) if r.random() < 0.5 else f"own {i}", None, None, None) for i in range(600)]
    got = balanced_shards(spark.createDataFrame(given, DOCS), shards=6).collect()
    check(got, given, 6)
    groups, where = defaultdict(set), {}
    size = Counter(t or "" for _, t, *_ in given)
    for g in got:
        text = next(t or "" for k, t, *_ in given[g["doc_id"] : g["doc_id"] + 1])
        groups[text].add(g["shard"])
        where[g["doc_id"]] = g["shard"]
    together = [t for t, n in size.items() if 2 <= n <= 25]
    assert together and sum(len(groups[t]) == 1 for t in together) >= 0.95 * len(together)


def test_a_group_larger_than_a_shard(spark):
    given = [(i, "same" if i < 500 else f"own {i}", None, None, None) for i in range(800)]
    got = balanced_shards(spark.createDataFrame(given, DOCS), shards=8).collect()
    check(got, given, 8)
    assert len({g["shard"] for g in got if g["doc_id"] < 500}) <= 8


def test_all_rows_linked(spark):
    given = [(i, f"t{i % 50}", None, None, None) for i in range(200)]
    check(balanced_shards(spark.createDataFrame(given, DOCS), shards=7).collect(), given, 7)


def test_odd_rows(spark):
    given = [tuple(r) for r in docs(spark).collect()]
    check(balanced_shards(clashing(docs(spark))).collect(), given, 24)
    assert rows(balanced_shards(docs(spark, []))) == []


def whole(got, group, sizes, most):
    """The share of groups of 2 to ``most`` rows that are in one shard."""
    where = defaultdict(set)
    for r in got:
        where[group(r["doc_id"])].add(r["shard"])
    few = [g for g, n in sizes.items() if 2 <= n <= most]
    return sum(len(where[g]) == 1 for g in few) / len(few)


@pytest.mark.parametrize("linked", [0.95, 0.99, 1.0])
def test_groups_come_together_in_a_table_of_copies(spark, linked):
    n, shards = 9600, 24
    group = lambda i: i % int(n * linked / 10) if i < n * linked else n + i
    given = [(i, f"t{group(i)}", None, None, None) for i in range(n)]
    got = balanced_shards(spark.createDataFrame(given, DOCS), shards=shards).collect()
    check(got, given, shards)
    assert whole(got, group, Counter(map(group, range(n))), 20) >= 0.98


def test_large_groups_that_fit_a_shard_are_not_cut(spark):
    sizes = [90, 80, 70, 60, 60, 55, 40, 35, 30, 20, 15]
    given = [(i, t, None, None, None) for i, t in enumerate([f"t{g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"own {i}" for i in range(245)])]
    group = lambda i: given[i][1]
    got = balanced_shards(spark.createDataFrame(given, DOCS), shards=8).collect()
    check(got, given, 8)
    assert whole(got, group, Counter(map(group, range(len(given)))), 100) == 1


def test_a_group_larger_than_a_shard_fills_shards(spark):
    given = [(i, "same" if i < 250 else f"t{i % 20}", None, None, None) for i in range(800)]
    got = balanced_shards(spark.createDataFrame(given, DOCS), shards=8).collect()
    check(got, given, 8)
    assert len({g["shard"] for g in got if g["doc_id"] < 250}) == 3


def test_cut_edges_are_counted(spark):
    r = random.Random(4)
    given = [(i, f"t{r.randrange(60)}" if i < 300 else f"own {i}", None, None, None) for i in range(500)]
    df = spark.createDataFrame(given, DOCS)
    done = balanced_shards(df, shards=6)
    where = defaultdict(list)
    for g in done.collect():
        where[given[g["doc_id"]][1]].append(g["shard"])
    links, cut = sum(len(x) - 1 for x in where.values()), sum(len(set(x)) - 1 for x in where.values())
    assert tuple(cut_edges(done, df).first()) == (links, cut)
    # A deal by hash of the key alone cuts most links; propagation cuts hardly any.
    dealt = sum(len({hash((k, t)) % 6 for k, u, *_ in given if u == t}) - 1 for t in where)
    assert cut <= 0.02 * links < 0.5 * dealt
    again = {g["doc_id"]: (g["shard"], g["slot"]) for g in balanced_shards(df.repartition(7), shards=6).collect()}
    assert again == {g["doc_id"]: (g["shard"], g["slot"]) for g in done.collect()}
