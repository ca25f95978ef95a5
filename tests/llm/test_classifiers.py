import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.quality import FACTORS, Machine, features, is_held_out, quality
from ledgerloom.llm.quality import fitted as quality_fitted
from ledgerloom.llm.toxicity import CLASSES, Restorer, Scorer, cluster, evidence, restored_words, tail, toxicity, trigram_counts, weigh
from ledgerloom.llm.toxicity import fitted as toxicity_fitted
from tests.llm.helpers import DOCS, clashing, docs, rows

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "dan", "sol") for b in ("na", "ris", "ven", "do", "pel", "gra")]
BAD = ["grumblefool", "snotwit", "dunderhead"]
LEET = str.maketrans({"o": "0", "e": "3", "i": "1", "t": "7", "s": "$"})


def held(key):
    import zlib

    return zlib.crc32(str(key).encode()) % 5 == 0


def made(seed, n=1200):
    r = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        words = r.choices(WORDS, k=r.randrange(20, 60))
        toxic, good = int(r.random() < 0.25), int(r.random() < 0.7)
        if toxic:
            for _ in range(2):
                bad = r.choice(BAD)
                form = r.randrange(4)
                words[r.randrange(len(words))] = [bad, bad.translate(LEET), " ".join(bad), bad.replace("o", "ooo", 1)][form] if i % 3 == 0 else bad
        text = " ".join(words)
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), " | ".join(words), " ".join([words[0]] * len(words))]) if not toxic else " | ".join(words)
        out.append((i, text, "en", "a", len(text)))
        labels.append((i, good, toxic))
    return out, labels


@pytest.fixture(scope="module")
def tables(spark):
    given, labels = made(3)
    return spark.createDataFrame(given, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(tables, name):
    df, labels, known = tables
    f, column = (quality, 1) if name == "quality" else (toxicity, 2)
    got = {r["doc_id"]: r for r in f(df, labels).collect()}
    assert len(got) == len(known)
    right = [got[k[0]]["predicted"] == k[column] for k in known if held(k[0])]
    assert len(right) > 150 and np.mean(right) > 0.95
    for k, r in got.items():
        assert r["held_out"] == held(k) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.3 if name == "quality" else 0.5))


def test_held_out_labels_and_other_columns_have_no_say(spark, tables):
    df, labels, _ = tables
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    changed = df.selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source", "0L as n_chars")
    for f in (quality, toxicity):
        assert rows(f(df, labels).select("doc_id", "score")) == rows(f(changed, turned).select("doc_id", "score"))


@pytest.mark.parametrize("f", [quality, toxicity])
def test_odd_rows(spark, tables, f):
    _, labels, _ = tables
    got = f(clashing(docs(spark)), labels.selectExpr("*", "1 as row")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs(spark).collect())
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[5] and by[2] == by[3]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    alone = f(docs(spark), none).collect()
    assert {round(r["score"], 6) for r in alone} == ({0.5} if f is quality else {0.0})
    assert rows(f(docs(spark, []), labels)) == []
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 1, 1), (1, 0, 0), (99, 1, 1), (4, 7, 7)], "doc_id long, quality int, toxic int")
    assert len(f(docs(spark), odd).collect()) == 9


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    m = Machine(0.3)
    m.w = r.normal(size=m.w.shape)
    m.v = r.normal(size=m.v.shape)
    index, value = features("some words make some features | of a text")
    slow = m.bias + sum(m.w[i] * x for i, x in zip(index, value, strict=True))
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            slow += (m.v[index[a]] @ m.v[index[b]]) * value[a] * value[b]
    assert m.margin(index, value) == pytest.approx(slow) and m.v.shape[1] == FACTORS


def test_viterbi_finds_the_cheapest_path():
    import itertools

    text = " ".join(random.Random(2).choices([*WORDS, "idiot", "total", "little"], k=4000))
    restorer = Restorer(trigram_counts(text).astype(float))
    for noisy in ("1d10t", "t0t4l", "l17tle", "mmmilll0", "k4n@"):
        best = min(
            (sum(x[1] for x in path) + spelt(restorer, "".join(x[0] for x in path)), "".join(x[0] for x in path)) for path in itertools.product(*restorer.lattice(noisy))
        )
        assert restorer.decode(noisy) == best[1]
    words = restored_words("you 1d10t! an i-d-i-o-t and i d i o t, really iiidiot. $olna", restorer, {})
    assert "idiot" in words and "you" in words and "solna" in words
    assert not any(c.isdigit() for w in words for c in w)


def spelt(restorer, word):
    from ledgerloom.llm.toxicity import _CLASS

    c = [0, 0, *[_CLASS.get(x, CLASSES - 1 if x.isalpha() else 0) for x in word], 0]
    return sum(restorer.cost[a][b][d] for a, b, d in zip(c, c[1:], c[2:], strict=False))


def test_hold_out_rule(spark):
    got = spark.range(200).select("id", is_held_out(F.col("id")).alias("x")).collect()
    assert all(r["x"] == held(r["id"]) for r in got)


def restorer_of_words(*more):
    text = " ".join(random.Random(2).choices([*WORDS, "a", "you", "stupid", "idiot", "moron", "clown", *more], k=4000))
    return Restorer(trigram_counts(text).astype(float))


def test_long_and_strung_words_are_restored():
    restorer = restorer_of_words()

    def begun(noisy, word):
        return any(w.startswith(word) for w in restored_words(noisy, restorer, {}))

    run = " ".join("solna" * 20)
    for noisy in ("st" + "u" * 36 + "pid", "solna." * 10 + "stupid", "a s t u p i d", "s t u p i d   i d i o t", f"{run}   s t u p i d", f"{run} s t u p i d", "-".join("solna" * 9 + "stupid")):
        assert begun(noisy, "stupid"), noisy
    assert begun("s t u p i d   i d i o t", "idiot") and begun("s t u p i d i d i o t", "idiot")
    assert begun(" ".join("solnakaris" * 5000), "solna")


def test_doubled_letters_and_signs_at_edges_are_restored():
    restorer = restorer_of_words()
    for noisy, word in (("stuupid", "stupid"), ("iidiot", "idiot"), ("mooron", "moron"), ("*diot", "idiot"), ("(lown", "clown"), ("(idiot)", "idiot"), ("**moron**", "moron"), ("you're a \"stup!d\"", "stupid")):
        assert word in restored_words(noisy, restorer, {}), noisy


@pytest.mark.parametrize("gap", [" ", "  ", "     ", "\t", "\n", " \n\n ", ".", "-", "_", "~", "*", "·", ",", "/", "\\", "'", " . ", "\u00a0"])
@pytest.mark.parametrize("letters", [6, 41, 400])
def test_every_separator_and_length(gap, letters):
    restorer = restorer_of_words()
    noisy = gap.join(("solnakarismiter" * letters)[: letters - 6] + "stupid")
    assert any(w.startswith("stupid") for w in restored_words(f"you {noisy}", restorer, {}))


def test_forty_thousand_letters():
    restorer = restorer_of_words()
    for noisy in (" ".join("solnakaris" * 4000 + "stupid"), "5" + "".join("solnakaris" * 4000) + "5tup1d", "stu" + "u" * 40_000 + "pid"):
        assert restored_words(noisy, restorer, {})
    assert any(w.startswith("stupid") for w in restored_words("stu" + "u" * 40_000 + "pid", restorer, {}))
    assert any(w.startswith("stupid") for w in restored_words(" ".join("solnakaris" * 4000 + "stupid"), restorer, {}))


def test_weights_are_not_chance_and_longer_stems_explain_shorter_ones():
    got = weigh([("lose", 40, 30), ("loser", 40, 0), ("loser$", 40, 0), ("rare", 3, 0), ("fine", 0, 400), ("both", 30, 270)], 300, 2700)
    assert set(got) == {"loser", "loser$", "fine"} and got["loser"] > 0 > got["fine"]
    assert tail(0, 9, 0.1) == 1 and tail(2, 2, 0.1) == pytest.approx(0.01) and tail(1, 2, 0.5) == pytest.approx(0.75)
    scorer = Scorer(restorer_of_words(), {"stupi": 4.0, "solna": -3.0}, (1.0, 0.5, -1.0), -1.0)
    assert scorer.score("solna solna dan") < scorer.score("dan") < scorer.score("st00pid stup1d solna")
    assert evidence([4.0, -3.0, 1.0]) == (4.0, pytest.approx(np.log(6)), pytest.approx(np.log(4)))


def test_near_copies_are_learnt_from_once():
    base = [f"w{i}" for i in range(200)]
    keys = {cluster(" ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(50)}
    assert len(keys) <= 5 and cluster("") == cluster("  ") and cluster("a b") != cluster("a c")


def plain_scores(given, labels, f):
    """Scores by a plain loop over all rows, with the fitted model alone taken from the operator's module."""
    if f is quality:
        machine = quality_fitted(given, labels)
        return {(r["doc_id"], r["text"]): 1 / (1 + np.exp(-machine.margin(*features(r["text"] or "")))) for r in given.collect()}
    counts, weights, slopes, bias = toxicity_fitted(given, labels)
    own = sum(trigram_counts(r["text"] or "") for r in given.collect())
    inside = lambda c: c.reshape(CLASSES, CLASSES, CLASSES)[1:, 1:, 1:]
    assert (inside(counts) == inside(own)).all() and inside(own).sum() > 1000
    restorer, out = Restorer(counts), {}
    for r in given.collect():
        found = []
        for w in restored_words(r["text"] or "", restorer, {}):
            every = [weights[s] for n in range(len(w) + 1) for s in ({w[:n]} if 4 <= n <= 7 else set()) if s in weights] + [weights[s] for s in [w + "$"] if s in weights]
            if every:
                found.append(max(every) if max(every) > 0 else min(every))
        up, down = [x for x in found if x > 0], [-x for x in found if x < 0]
        margin = slopes[0] * max(up, default=0) + slopes[1] * np.log1p(sum(up)) + slopes[2] * np.log1p(sum(down)) + bias
        out[r["doc_id"], r["text"]] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return out


@pytest.mark.parametrize("f", [quality, toxicity])
def test_whole_result_by_a_plain_loop(tables, f):
    df, labels, _ = tables
    given = df.where("doc_id between 100 and 400").unionByName(docs(df.sparkSession))
    want = plain_scores(given, labels, f)
    got = f(given, labels).collect()
    ids = {k: v for (k, _), v in want.items()}
    assert len(got) == given.count()
    for r in got:
        assert r["score"] == pytest.approx(ids[r["doc_id"]], abs=1e-9)


def test_columns_of_any_name(spark, tables):
    _, labels, _ = tables
    odd = docs(spark).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    from ledgerloom.llm.quality import quality_scores
    from ledgerloom.llm.toxicity import toxicity_scores

    for f in (quality_scores, toxicity_scores):
        assert f(odd, labels).select("row.*").columns == odd.columns
