import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.common import scratch_root
from ledgerloom.llm.queries import oracle_sql, queries
from tests.llm.helpers import DOCS
from tests.llm.test_classifiers import BAD, WORDS, made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    given, labels = made(5, 500)
    r = random.Random(6)
    extra = []
    for i in range(40):
        base = r.choices(WORDS, k=80)
        extra += [(10_000 + 3 * i + j, " ".join([*base[:78], f"x{j}", "y"]), "en", "b", 1) for j in range(3)]
    rows = given + extra + [(20_000, None, None, None, None), (None, " ".join(r.choices(WORDS, k=30)), "en", "a", 1)] + extra[:2]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'z' as row", "1 as _slot", "2 as `a.b`").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, {k: (q, t) for k, q, t in labels}


def test_stages_in_turn(spark, folder):
    path, rows, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "mix", "tokens"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.mode("overwrite").parquet(f"{path}/out-{name}")
        out = spark.read.parquet(f"{path}/out-{name}")
        if name != "tokens":
            assert out.columns == docs.columns
        texts[name] = out
        docs = out
    ids = {n: [r["doc_id"] for r in t.select("doc_id").collect()] for n, t in texts.items()}
    assert set(ids["near_duplicates"]) <= set(ids["toxicity"]) <= set(ids["quality"])
    kept = set(ids["quality"])
    right = [(k in kept) == bool(q) for k, (q, _) in labels.items()]
    assert sum(right) > 0.95 * len(right)
    kept = set(ids["toxicity"])
    assert sum(t for k, (_, t) in labels.items() if k in kept) <= 0.05 * sum(t for _, t in labels.values())
    clean = [k for k, (q, t) in labels.items() if q and not t]
    assert sum(k in kept for k in clean) > 0.95 * len(clean)
    copies = [k for k in ids["near_duplicates"] if k and 10_000 <= k < 20_000]
    assert len(copies) == 40 == len(set(copies)) and all((k - 10_000) % 3 == 0 for k in copies)
    assert sorted(map(str, ids["mix"])) == sorted(map(str, ids["near_duplicates"])) == sorted(map(str, ids["tokens"]))
    assert None in ids["tokens"] and BAD


def test_run_is_the_stages(spark, folder):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path)
    want = spark.read.parquet(f"{path}/out-tokens")
    pick = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(str, got.select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_near(rows):
    """The near-duplicate stage by brute force: rows by (id, text), groups by similar sets of five words, the first row of each stays."""
    distinct = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None})
    kept, low = [], list(range(len(distinct)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    sets = []
    for _, text in distinct:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, t) in enumerate(distinct):
        groups.setdefault(root(i), []).append((k, hashlib.md5(t.encode()).hexdigest(), t))
    for g in groups.values():
        k, _, t = min(g)
        kept.append((k, t))
    return sorted([*kept, *((None, r["text"] or "") for r in rows if r["doc_id"] is None)], key=str)


@pytest.mark.parametrize("repeated", [False, True])
def test_near_duplicates_by_brute_force(spark, repeated):
    import random

    r = random.Random(11)
    out = []
    for i in range(150):
        words = r.choices(WORDS, k=r.choice([0, 3, 5, 40, 60]))
        if out and r.random() < 0.5:
            words = (r.choice(out)[1] or "").split()
            if words and r.random() < 0.6:
                words[r.randrange(len(words))] = "new"
        out.append((r.randrange(40) if repeated and i % 3 == 0 else 1000 + i, " ".join(words) or None, "en", "a", i))
    out += [(None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1)] + ([out[0], out[0]] if repeated else [])
    df = spark.createDataFrame(out, DOCS).withColumn("a.b", F.lit(1)).withColumn("key", F.lit("k")).withColumn("id", F.lit("i"))
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((g["doc_id"], g["text"] or "") for g in got.collect()), key=str) == plain_near([g.asDict() for g in df.collect()])


def test_mix_of_equal_keys_and_odd_names(spark):
    rows = [(None, "t", "en", "src0", 1)] * 40 + [(7, "u", "en", None, 1)] * 40
    df = spark.createDataFrame(rows, DOCS).withColumn("a.b", F.lit(1)).withColumn("_slot", F.lit("x")).withColumn("row", F.lit("y"))
    got = corpus_pipeline.mix(spark, df, "")
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_scratch_of_a_run_is_dropped(spark, folder):
    import os

    root = scratch_root(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    corpus_pipeline.run(spark, folder[0])
    (left,) = set(os.listdir(root)) - before
    assert os.listdir(f"{root}/{left}") == ["tokens"]


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(queries()) and corpus_pipeline.ORACLE_SQL is None
