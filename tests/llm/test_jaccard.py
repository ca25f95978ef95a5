import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import jaccard
from ledgerloom.llm.jaccard import bitmap, bits_for, folded, jaccard_classes, plausible, shingles, similar
from tests.llm.helpers import DOCS, ODD, clashing, docs, rows


def brute(given, width=5, percent=80):
    sets = []
    for key, text in given:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((key, {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()))
    low = {k: k for k, _ in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for (k, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(k), root(j)
            low[max(x, y)] = min(x, y)
    return sorted((k, len(s), root(k)) for k, s in sets)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = r.choices(vocabulary, k=60)
    out = []
    for i in range(n):
        kind = r.randrange(6)
        if kind == 0 or not out:
            words = r.choices(vocabulary, k=r.choice([1, 3, 5, 6, 30, 90, 300]))
        elif kind == 1:
            words = passage + r.choices(vocabulary, k=r.randrange(30))
        else:
            words = list(r.choice(out)[1].split())
            for _ in range(r.randrange(max(1, len(words) // 12) + 2)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "TILE", 7)  # so that small groups are split as well
    monkeypatch.setattr(jaccard, "FREQUENT", 1 + seed)
    given = corpus(seed)
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in given], DOCS)
    assert rows(jaccard_classes(df)) == sorted(brute(given), key=str)


def test_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = r.choices([f"w{i}" for i in range(500)], k=200)
    given = []
    for i in range(250):
        words = list(base)
        for j in r.sample(range(200), r.randrange(5)):
            words[j] = f"x{i}-{j}"
        given.append((i, " ".join(words)))
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in given], DOCS)
    assert rows(jaccard_classes(df)) == sorted(brute(given), key=str)


def test_odd_rows(spark):
    got = rows(jaccard_classes(clashing(docs(spark))))
    assert got == sorted(brute([(k, t) for k, t, *_ in ODD if k is not None]), key=str)
    assert (5, 5, 1) in got and (2, 0, 2) in got and (6, 0, 6) in got and got[3][2] == 4
    assert rows(jaccard_classes(docs(spark, []))) == []
    two = docs(spark, [(9, "a b c d e f", None, None, None), (9, "q r s t u v", None, None, None), (11, "q r s t u v", None, None, None), (3, "A B C D E F", None, None, None)])
    assert rows(jaccard_classes(two)) == [(11, 2, 3), (3, 2, 3), (9, 2, 3), (9, 2, 3)]


def test_exactly_at_the_threshold(spark):
    # 18 shingles of 20 shared: 16 of 20 is 80 in 100, 15 is not.
    words = [f"w{i}" for i in range(22)]
    assert len(shingles(" ".join(words).encode(), 5)) == 18
    a, b = np.arange(18, dtype=np.uint64), np.arange(2, 20, dtype=np.uint64)
    assert similar(a, b, 80) and not similar(a, np.arange(3, 21, dtype=np.uint64), 80)


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(r.integers(0, max(1, n // 4))) :], r.integers(0, 2**63, int(r.integers(0, 40))).astype(np.uint64))))
        if len(a) and len(b) and similar(a, b, 80):
            assert plausible(bitmap(a, bits_for(len(a))).tobytes(), bitmap(b, bits_for(len(b))).tobytes(), len(a), len(b), 80)
        wide = bitmap(a, 1024)
        assert (folded(wide, 16) == bitmap(a, 128)).all()
