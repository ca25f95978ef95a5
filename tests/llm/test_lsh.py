import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lsh
from ledgerloom.llm.lsh import Projections, hashings, meets, near_duplicates
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(given, threshold=0.93):
    good = {}
    for k, (i, v, label) in enumerate(given):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            x = np.array(v, np.float32).astype(np.float64)
            if np.abs(x).max() > 0:
                good[k] = (label, len(v), x / np.sqrt(x @ x))
    links = [0] * len(given)
    low = {i: i for i, *_ in given}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    items = list(good.items())
    for a, (k, (la, na, x)) in enumerate(items):
        for j, (lb, nb, y) in items[a + 1 :]:
            if la == lb and na == nb and x @ y >= threshold:
                links[k] += 1
                links[j] += 1
                p, q = root(given[k][0]), root(given[j][0])
                low[max(p, q)] = min(p, q)
    return sorted(((i, links[k], root(i), i == root(i)) for k, (i, *_) in enumerate(given)), key=str)


def vectors(seed, n=300, size=16):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            base = np.array(out[r.integers(0, len(out))][1])
            v = base + r.normal(0, r.choice([0.0, 0.02, 0.08, 0.15]), size)
        else:
            v = r.normal(size=size)
        out.append((i, [float(np.float32(x)) for x in v], int(r.integers(0, 3))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lsh, "TILE", 9)
    given = vectors(seed)
    assert rows(near_duplicates(spark.createDataFrame(given, SCHEMA))) == brute(given)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [2.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-38, 0.0], 1)]
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "'x' as id", "1 as n", "1 as u")
    assert rows(near_duplicates(df)) == brute(given)
    assert rows(near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    assert rows(near_duplicates(spark.createDataFrame([(None, [1.0], 1)], SCHEMA))) == []


def test_large_group_of_copies(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=24)
    given = [(i, [float(np.float32(x)) for x in (base if i % 2 else base + r.normal(0, 0.03, 24))], 1) for i in range(400)]
    assert rows(near_duplicates(spark.createDataFrame(given, SCHEMA))) == brute(given)


def test_repeated_ids_keep_their_own_links(spark):
    given = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, None, 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, [0.01, 1.0], 1), (1, [1.0, 0.0], None)]
    assert rows(near_duplicates(spark.createDataFrame(given, SCHEMA))) == brute(given)


@pytest.mark.parametrize("crowd", [300, 200_000, 10**9])
def test_tables_and_hashes_grow_with_a_label(spark, crowd):
    """However many hashes the label's size asks for, a pair at the threshold meets, and its signs pass."""
    one = hashings(spark.createDataFrame([(1, 2)], "label int, size int").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3)))), 0.93)
    assert one.first()["hashes"] == lsh.LEAST_HASHES
    r = np.random.default_rng(6)
    hashes = max(lsh.LEAST_HASHES, int(np.ceil(np.log(crowd / lsh.CROWD) / -np.log(meets(0.0)))))
    assert crowd * meets(0.0) ** hashes <= lsh.CROWD
    tables = int(np.ceil(np.log(lsh.MISSED) / np.log1p(-(meets(0.93) ** hashes))))
    p = Projections(64, tables, hashes, lsh.WIDTH)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.normal(size=(400, 64))
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side
    assert (p.buckets(x) == p.buckets(y)).any(1).mean() > 0.995
    apart = np.bitwise_count(p.signs(x) ^ p.signs(y)).sum(1)
    assert apart.max() <= lsh.signs_apart(0.93) < np.bitwise_count(p.signs(x) ^ p.signs(x[::-1])).sum(1)[:200].mean()
