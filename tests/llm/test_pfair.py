import random
from collections import Counter, defaultdict
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import rank_buckets
from ledgerloom.llm.pfair import OTHER, TARGETS, mix_places, mixed, period, phases
from tests.llm.helpers import DOCS, clashing, docs, rows


@pytest.mark.parametrize("seed", range(6))
def test_less_than_one_block_off(seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.randrange(1, 40) for i in range(r.randrange(1, 12))}
    slots, total = period(weights), sum(weights.values())
    assert Counter(slots) == weights
    seen = Counter()
    for t, s in enumerate(slots, 1):
        seen[s] += 1
        j = seen[s] - 1
        assert floor(j * total / weights[s]) <= t - 1 < ceil((j + 1) * total / weights[s])
        assert all(abs(seen[x] - t * p / total) < 1 for x, p in weights.items())


@pytest.mark.parametrize("seed", range(6))
def test_phases_schedule_every_block_once(seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.randrange(0, 9) for i in range(6)} | {OTHER: 1}
    blocks = {s: r.randrange(0, 60) for s in weights}
    plan = phases(blocks, weights)
    done = Counter()
    for a, b in zip(plan, [*plan[1:], None], strict=True):
        assert a["slots"] == sum(a["runs"].values())
        for s, n in a["runs"].items():
            assert a["first"][s] == done[s]
            done[s] += n
        if b:
            assert b["start"] == a["start"] + a["slots"]
    assert +done == +Counter(blocks)


def test_every_row_has_its_place(spark):
    r = random.Random(1)
    names = ["a", "b", "c", "d", None]
    given = [(i, None, None, r.choices(names, [60, 20, 10, 5, 5])[0], None) for i in range(900)]
    weights = {"a": 2, "b": 2, "c": 1, OTHER: 1}
    got = mix_places(spark.createDataFrame(given, DOCS), weights, block=8).collect()
    assert sorted(g["doc_id"] for g in got) == list(range(900))
    by = defaultdict(list)
    for g in got:
        assert g["source"] == given[g["doc_id"]][3] and g["stream"] == (g["source"] if g["source"] in weights else OTHER)
        by[g["slot"]].append(g)
    assert sorted(by) == list(range(len(by)))
    for rows_ in by.values():
        assert len({(g["stream"], g["block"]) for g in rows_}) == 1 and sorted(g["block_offset"] for g in rows_) == list(range(len(rows_)))
    first = [s for s in sorted(by) if by[s][0]["phase"] == 0]
    seen = Counter()
    for t, s in enumerate(first, 1):
        seen[by[s][0]["stream"]] += 1
        assert all(abs(seen[x] - t * p / 6) < 1 for x, p in weights.items())
        g = by[s][0]
        assert g["release"] <= g["slot"] < g["due"]


def test_odd_rows(spark):
    got = mix_places(clashing(docs(spark)), {"a": 1, "b": 0, OTHER: 2}, block=2)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in docs(spark).collect())
    assert rows(mix_places(docs(spark, []))) == []
    with pytest.raises(ValueError):
        mixed(docs(spark), {"a": -1})
    assert sum(TARGETS.values()) == 100


def plain_mix(given, weights, block):
    """The whole mix by one loop over slots: rows of each stream in the order of their hashes, earliest deadline first, phase by phase."""
    queues = defaultdict(list)
    for h, key, source in sorted(given, key=lambda x: (x[0] % rank_buckets(len(given)), x[0])):
        queues[source if source in weights and source != OTHER else OTHER].append(key)
    blocks = {s: [q[i : i + block] for i in range(0, len(q), block)] for s, q in queues.items()}
    out, slot, phase = {}, 0, 0
    while any(blocks.values()):
        live = {s: weights.get(s, 0) for s in blocks if blocks[s]}
        live = {s: p for s, p in live.items() if p} or dict.fromkeys(live, 1)
        total, done, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while True:
            released = [(ceil((done[s] + 1) * total / p), s) for s, p in live.items() if floor(done[s] * total / p) <= t]
            due, s = min(released)
            if not blocks[s]:
                break
            for i, key in enumerate(blocks[s].pop(0)):
                out[key] = (s, phase, slot, i, floor(done[s] * total / live[s]), due)
            done[s], slot, t = done[s] + 1, slot + 1, t + 1
        phase += t > 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_whole_mix_by_a_plain_loop(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    given = [(i, f"t{i}", None, r.choices(names, [50, 30, 10, 5, 5])[0], None) for i in range(700)]
    weights = {"a": 3, "b": 2, "c": 1, "d": 0, OTHER: 1}
    df = spark.createDataFrame(given, DOCS)
    key = F.xxhash64(F.col("doc_id").cast("string"), "source", F.xxhash64("text"))
    want = plain_mix([tuple(x) for x in df.select(key, "doc_id", "source").collect()], weights, 4)
    got = {g["doc_id"]: (g["stream"], g["phase"], g["slot"], g["block_offset"], g["release"], g["due"]) for g in mix_places(df, weights, block=4).collect()}
    assert got == want


def test_names_that_clash_and_null_keys_are_spread(spark):
    given = [(None, f"t{i}", "en", "a", i) for i in range(200)] + [(None, "same", "en", "a", 0)] * 5
    df = spark.createDataFrame(given, DOCS).selectExpr("*", *[f"'x' as {c}" for c in ("_phase", "_first", "_bucket", "_stream", "_rank", "_spread", "_s", "_j", "_at")]).withColumn("a.b", F.lit(1))
    got = mixed(df, {"a": 1}, 8, ties=("source", "text"))
    assert got.select("row.*").columns == df.columns
    places = got.select("_slot", "_offset", "row.text").collect()
    assert sorted((p["_slot"], p["_offset"]) for p in places) == [(i // 8, i % 8) for i in range(205)] and sum(p["text"] == "same" for p in places) == 5
