import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.chat import chains, chat_digests, escape, format_trees, masked_text, parse, unescape
from tests.llm.helpers import rows

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<|im_end|>\n", "<\\\\|im_start|>", "[\\INST]", "<<SYS>>x<</SYS>>", "\\", "", "a\nb", "<<s>", "$1 \\2", "😀<s>"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(x + y,) for x in NASTY for y in NASTY], "x string").select("x", escape(F.col("x")).alias("e")).select("x", "e", unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["x"]
        assert not any(c in r["e"] for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>"))


def test_chains(spark):
    turns = [(1, i, ["user", "assistant", None, "tool%\n"][i % 4], t) for i, t in enumerate(NASTY)]
    turns += [(2, 0, "assistant", None), (3, 1, "user", "b"), (3, 0, "user", "a"), (3, 1, "user", "b"), (None, 0, "user", "lost"), (4, None, "user", "first"), (4, 0, "assistant", "x" * 50_000)]
    got = {r["conv_id"]: r for r in chat_digests(spark.createDataFrame(turns, TURNS).withColumn("tree", F.lit(1)).withColumn("score", F.lit("x"))).collect()}
    for conv in (1, 2, 3, 4):
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in turns if c == conv)
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), digest(loss))
    assert set(got) == {1, 2, 3, 4}
    assert rows(chat_digests(spark.createDataFrame([], TURNS))) == []


def test_branches_are_ranked(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 3.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.0), (1, 5, 3, "user", "tie", 2.0), (2, 1, 9, "user", "root with a lost parent", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    every = format_trees(df, None).select("tree", "leaf", "rank", parse(F.col("formatted")).alias("t"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    said = {(r["tree"], r["leaf"]): (r["rank"], [x["text"] for x in r["t"]], r["loss"]) for r in every}
    assert said == {(1, 4): (1, ["q", "good", "more"], "good"), (1, 5): (2, ["q", "bad", "tie"], "bad"), (2, 1): (1, ["root with a lost parent"], "")}
    assert sorted((r["tree"], r["leaf"]) for r in format_trees(df).collect()) == [(1, 4), (2, 1)]


def test_repeated_node_ids(spark):
    """Rows of a leaf's id are leaves of their own; of an inner node's id the first row counts, once."""
    nodes = [(1, 1, None, "user", "q", 1.0), (1, 1, None, "user", "z", 9.0), (1, 2, 1, "assistant", "a", 1.0), (1, 2, 1, "assistant", "b", 2.0), (1, 2, 1, "assistant", "b", 2.0), (2, 5, None, "user", "alone", None), (2, 5, None, "user", "alone", None)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double").withColumn("copy", F.lit(7)).withColumn("at", F.lit("x"))
    got = sorted((r["tree"], r["leaf"], r["rank"], [x["text"] for x in r["t"]], r["loss"]) for r in format_trees(df, None).select("tree", "leaf", "rank", parse(F.col("formatted")).alias("t"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect())
    assert got == [(1, 2, 1, ["q", "b"], "b"), (1, 2, 2, ["q", "b"], "b"), (1, 2, 3, ["q", "a"], "a"), (2, 5, 1, ["alone"], ""), (2, 5, 2, ["alone"], "")]


def plain_paths(nodes):
    """Every root-to-leaf path of a tree, best sum first, equal ones by leaf."""
    by = {n: (p, role, text, s) for n, p, role, text, s in nodes}
    inner = {p for p, *_ in by.values() if p in by}
    out = []
    for leaf in by:
        if leaf not in inner:
            path, n = [], leaf
            while n is not None:
                path.append(n)
                n = by[n][0] if by[n][0] in by else None
            out.append((-sum(by[n][3] for n in path), leaf, [by[n][2] for n in reversed(path)]))
    return [(leaf, i + 1, texts) for i, (_, leaf, texts) in enumerate(sorted(out))]


@pytest.mark.parametrize("branches", [1, 3, None])
def test_random_trees_by_a_plain_loop(spark, branches):
    import random

    r = random.Random(8)
    rows_, want = [], {}
    for tree in range(12):
        ids = r.sample(range(1000), r.randrange(1, 40))
        nodes = [(n, r.choice(ids[:i]) if i and r.random() < 0.9 else r.choice([None, 5000]), r.choice(["user", "assistant"]), f"t{n} {r.choice(NASTY)}", float(r.randrange(5))) for i, n in enumerate(ids)]
        rows_ += [(tree, *n) for n in nodes]
        want[tree] = plain_paths(nodes)[:branches]
    df = spark.createDataFrame(rows_, "tree long, node long, parent long, role string, text string, score double")
    got = {}
    for x in format_trees(df, branches).select("tree", "leaf", "rank", parse(F.col("formatted")).alias("t")).collect():
        got.setdefault(x["tree"], []).append((x["leaf"], x["rank"], [y["text"] for y in x["t"]]))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == want


def test_deep_path_and_circle(spark):
    n = 300
    deep = spark.range(n).select(F.lit(1).cast("long").alias("tree"), (F.col("id") + 1).alias("node"), F.when(F.col("id") > 0, F.col("id")).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    (one,) = format_trees(deep).select(parse(F.col("formatted")).alias("t")).collect()
    assert [x["text"] for x in one["t"]] == [str(i) for i in range(n)]
    ring = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], "tree long, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="circle"):
        format_trees(ring).collect()


def test_main_path_has_no_python(spark):
    df = chat_digests(spark.createDataFrame([(1, 0, "user", "a")], TURNS))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert chains(spark.createDataFrame([(1, 0, "user", "a")], TURNS)).columns == ["tree", "node", "parent", "role", "text", "score"]
