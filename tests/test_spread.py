"""Steps on large tables run in the same way at every size: no broadcast of what grows, no shuffle more than needed."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import spread
from ledgerloom.plans import tables as D
from ledgerloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_input(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).write.parquet(path)
    t = spark.read.parquet(path)
    assert 0 < spread.input_bytes(t) < spread.input_bytes(t, t)
    assert spread.input_bytes(spark.createDataFrame([(1,)], "a int").where("a > 5")) < 1 << 30
    assert spread.partitions(t) == spark.sparkContext.defaultParallelism
    share, spread.SHARE = spread.SHARE, 100
    try:
        assert spread.partitions(t) == -(-spread.input_bytes(t) // 100) > 8
    finally:
        spread.SHARE = share


@needs_data
def test_entries_of_a_transaction_are_in_place(spark):
    entries = D.entries(spark, DATA)
    text = plan(entries.groupBy("transaction_id").agg(F.min_by("account_id", "id")))
    assert text.count("Exchange hashpartitioning") == 2 and "Broadcast" not in text  # lines and orders


@needs_data
def test_export_shuffles_entries_by_account_once(spark):
    text = plan(QUERIES["export_window"][0](spark, DATA))
    assert "Broadcast" not in text
    assert text.count("Exchange hashpartitioning(account_id") == 1 and text.count("Exchange hashpartitioning(transaction_id") == 2  # lines, and what is aggregated


@needs_data
def test_foreign_keys_are_checked_without_sorts(spark):
    text = plan(QUERIES["fk_violations"][0](spark, DATA))
    assert text.count("ShuffledHashJoin") == 3 and "Broadcast" not in text
    assert "Sort [account_id" not in text and "HashAggregate" not in text  # neither entries by account nor distinct parents


def test_orphans_with_repeated_parents(spark):
    from ledgerloom.operators import audit

    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "x")], "id string, p string")
    parents = spark.createDataFrame([("x",), ("x",), (None,)], "id string")
    assert [r["id"] for r in audit.orphans(rows, "p", parents).collect()] == ["b"]


@needs_data
def test_unknown_accounts_are_counted_first(spark):
    text = plan(QUERIES["unknown_accounts"][0](spark, DATA))
    assert text.index("LeftAnti") < text.index("HashAggregate") and "Sort [account_id" not in text and "Broadcast" not in text


def test_currency_conflicts_of_several_currencies(spark):
    from ledgerloom.operators import audit

    a = spark.createDataFrame([("n1", "NGN"), ("n2", "NGN"), ("u", "USD"), ("none", None)], "id string, currency string")
    e = spark.createDataFrame([(f"{x}-{c}", x, c) for x in ("n1", "u", "none", "gone") for c in ("NGN", "USD", "EUR", None)], "id string, account_id string, currency string")
    got = sorted((r["id"], r["account_currency"]) for r in audit.currency_conflicts(e, a).collect())
    assert got == [("n1-EUR", "NGN"), ("n1-USD", "NGN"), ("u-EUR", "USD"), ("u-NGN", "USD")]
    assert audit.currency_conflicts(e, a.where("currency is null")).isEmpty()


@needs_data
def test_entries_in_the_usual_currency_are_not_shuffled_to_accounts(spark):
    df = QUERIES["currency_conflicts"][0](spark, DATA)
    text = plan(df)
    assert text.count("Exchange hashpartitioning(account_id") == 1 and "Broadcast" not in text
    assert "currency = NGN" in text.split("Exchange hashpartitioning(account_id")[1]  # the filter on entries is below their shuffle


@needs_data
def test_running_balances_deal_entries_out_once(spark):
    df = QUERIES["running_balance"][0](spark, DATA)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert "Broadcast" not in text and "ReusedExchange" in text


def test_running_balances_over_periods(spark):
    import random

    from ledgerloom.operators import ledger

    r = random.Random(5)
    rows = [(f"e{i}", r.choice(["A", "L", "gone"]), r.choice(["debit", "credit"]), r.randrange(100), r.choice([None, f"20{r.randrange(10, 13)}-{r.randrange(1, 13):02}-{r.randrange(1, 28):02}"])) for i in range(300)]
    e = spark.createDataFrame(rows, "id string, account_id string, direction string, amount_minor long, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    a = spark.createDataFrame([("A", "asset"), ("L", "liability")], "id string, type string")
    want, sums = {}, {"A": 0, "L": 0}
    for i, account, direction, amount, _ in sorted(rows, key=lambda x: (x[4] or "", x[0])):
        if account in sums:
            sums[account] += amount if (account == "A") == (direction == "debit") else -amount
            want[i] = sums[account]
    for every in ("day", "month", "year"):
        assert {x["id"]: x["balance_minor"] for x in ledger.running_balances(a, e, every).collect()} == want


def test_a_streamed_batch_sorts_its_sides_for_the_match_only(spark):
    from ledgerloom.sources import generate
    from ledgerloom.streaming.matching import match_batch

    inside, outside = generate.fixture(spark, 200, 5, 7)
    seen = outside.where("seq % 3 = 0").select("reference").unionByName(outside.where("seq % 3 = 0").select("reference"))
    df = match_batch(inside, outside, seen)
    known = {r["reference"] for r in seen.collect()}
    got = df.collect()
    assert sum(r["category"] == "duplicate" and r["reference"] in known for r in got) == sum(r["reference"] in known for r in outside.collect()) > 0
    assert len(got) == outside.count() and all(r["external"] is not None for r in got)
    assert "ShuffledHashJoin" in (text := plan(df)) and "REPARTITION_BY_NUM" in text


@needs_data
def test_an_export_to_files_broadcasts_nothing(spark):
    from ledgerloom.operators import ledger

    start, end = (F.lit(x).cast("timestamp") for x in ("1995-01-01", "1996-01-01"))
    text = plan(ledger.export(D.transactions(spark, DATA), D.entries(spark, DATA), D.accounts(spark, DATA), start, end).orderBy("initiated_at", "transaction_id"))
    assert "Broadcast" not in text and text.count("ShuffledHashJoin") == 2


@needs_data
def test_an_export_moves_one_row_a_transaction_account_and_direction(spark):
    from ledgerloom.operators import ledger

    start, end = (F.lit(x).cast("timestamp") for x in ("1995-01-01", "1996-01-01"))
    df = ledger.export(D.transactions(spark, DATA), D.entries(spark, DATA), D.accounts(spark, DATA), start, end)
    df.collect()
    final, first = plan(df).split("== Initial Plan ==")
    assert "Broadcast" not in final  # nor when small results are known at run time
    below = first.split("Exchange hashpartitioning(account_id")[1].split("\n")
    assert "REPARTITION_BY_NUM" in first.split("Exchange hashpartitioning(account_id")[0] and "SortAggregate(key=[transaction_id" in below[1] and "account_id" in below[1]


def test_exports_against_plain_loops(spark):
    import random

    from ledgerloom.operators import ledger

    r = random.Random(7)
    rows = [(f"e{i}", f"t{r.randrange(40)}", r.choice(["A", "B", "C", "gone", None]), r.choice(["debit", "credit", "odd", None]), r.randrange(100), r.choice(["NGN", "USD", None]), r.choice([None, "2011-01-01", "2011-01-02", "2011-01-03"])) for i in range(300)]
    e = spark.createDataFrame(rows, "id string, transaction_id string, account_id string, direction string, amount_minor long, currency string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    a = spark.createDataFrame([(x, f"code {x}") for x in "ABC"], "id string, code string")
    t = spark.createDataFrame([(f"t{i}", f"2012-01-{i % 28 + 1:02}") for i in range(45)], "id string, at string").select(
        "id", F.lit("r").alias("reference"), F.lit("transfer").alias("type"), F.lit("settled").alias("status"), F.col("at").cast("timestamp").alias("initiated_at"), F.lit(None).cast("timestamp").alias("settled_at"), F.lit(None).cast("map<string,string>").alias("metadata")
    )
    want = {}
    for i in range(45):
        own = sorted((x for x in rows if x[1] == f"t{i}" and x[2] in ("A", "B", "C")), key=lambda x: (x[6] or "", x[0]))
        side = lambda d: next((f"code {x[2]}" for x in own if x[3] == d), "")  # noqa: E731, B023
        want[f"t{i}"] = (side("credit"), side("debit"), sum(x[4] for x in own if x[3] == "debit"), own[0][5] or "" if own else "")
    take = lambda df: {x["transaction_id"]: (x["source"], x["destination"], x["amount_minor"], x["currency"]) for x in df.collect()}
    assert take(ledger.export(t, e, a)) == want
    inside = {k: v for k, v in want.items() if 4 <= int(k[1:]) % 28 < 9}
    assert take(ledger.export(t, e, a, F.lit("2012-01-05").cast("timestamp"), F.lit("2012-01-10").cast("timestamp"))) == inside
