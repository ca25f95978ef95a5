import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, ledger

ENTRY = "id string, transaction_id string, account_id string, direction string, amount_minor long, currency string"


def accounts(spark, n):
    return spark.createDataFrame([(f"A{i}", f"A{i}", "asset", "NGN") for i in range(n)] + [("S", "S", "liability", "NGN")], "id string, code string, type string, currency string")


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY).withColumn("created_at", F.lit("2026-05-31").cast("timestamp"))


@pytest.mark.parametrize("seed", range(3))
def test_value_is_conserved(spark, seed):
    r = random.Random(seed)
    n = r.randrange(2, 6)
    rows, start = [], 0
    for i in range(n):
        opening = r.randrange(1, 1_000_001)
        start += opening
        rows += [(f"o{i}d", f"o{i}", f"A{i}", "debit", opening, "NGN"), (f"o{i}c", f"o{i}", "S", "credit", opening, "NGN")]
    for t in range(r.randrange(21)):
        a, b = r.sample(range(n), 2)
        x = r.randrange(1, 1_000_001)
        rows += [(f"t{t}c", f"t{t}", f"A{a}", "credit", x, "NGN"), (f"t{t}d", f"t{t}", f"A{b}", "debit", x, "NGN")]
    e = entries(spark, rows)
    assert ledger.conservation(accounts(spark, n), e, ("asset",)).first()[0] == start
    assert ledger.unbalanced(e).isEmpty() and ledger.unbalanced(e, by_currency=False).isEmpty()


def test_posting_errors_come_in_order(spark):
    rows = [
        ("1", "one", "A0", "debit", 5, "NGN"),
        ("2", "money", "A0", "debit", 5, "NGN"), ("3", "money", "S", "credit", 5, "USD"),
        ("4", "zero", "A0", "debit", 0, "NGN"), ("5", "zero", "S", "credit", 0, "NGN"),
        ("6", "way", "A0", "debit", 5, "NGN"), ("7", "way", "S", "odd", 5, "NGN"),
        ("8", "sum", "A0", "debit", 5000, "NGN"), ("9", "sum", "S", "credit", 4000, "NGN"),
        ("a", "who", "A9", "debit", 5, "NGN"), ("b", "who", "S", "credit", 5, "NGN"),
        ("c", "good", "A0", "debit", 5, "NGN"), ("d", "good", "S", "credit", 5, "NGN"),
    ]
    # Entry by entry: what is wrong with the first bad entry counts, its currency before its amount.
    rows += [("e", "low first", "A0", "debit", 0, "NGN"), ("f", "low first", "S", "credit", 5, "USD"), ("g", "both", "A0", "debit", 5, "NGN"), ("h", "both", "S", "credit", 0, "USD"), ("i", "back", "A0", "debit", 5, "NGN"), ("j", "back", "A0", "debit", 0, "NGN"), ("k", "back", "S", "credit", 5, "USD")]
    got = {r["transaction_id"]: r["error"] for r in ledger.posting_errors(entries(spark, rows), accounts(spark, 1)).collect()}
    assert (got.pop("low first"), got.pop("both"), got.pop("back")) == ("non_positive_amount", "currency_mismatch", "non_positive_amount")
    assert got == {"one": "too_few_entries", "money": "currency_mismatch", "zero": "non_positive_amount", "way": "invalid_direction", "sum": "unbalanced", "who": "unknown_account", "good": None}


def test_posting_is_idempotent(spark):
    e = entries(spark, [x for t in ("p", "q", "r") for x in ((f"{t}d", t, "A0", "debit", 5, "NGN"), (f"{t}c", t, "S", "credit", 5, "NGN"))])
    requests = spark.createDataFrame([("p", "k1", 1), ("q", "k1", 2), ("r", "k0", 3), ("none", None, 4)], "id string, idempotency_key string, seq long")
    posted = spark.createDataFrame([("k0",)], "idempotency_key string")
    good, rows, bad = ledger.post(requests, e, accounts(spark, 1), posted)
    assert [r["id"] for r in good.collect()] == ["p"] and rows.count() == 2
    assert [(r["id"], r["error"]) for r in bad.collect()] == [("none", "too_few_entries")]


def test_balances(spark):
    e = entries(spark, [("1", "t", "A0", "debit", 7, "NGN"), ("2", "t", "S", "credit", 7, "NGN")])
    assert {r["account_id"]: r["balance_minor"] for r in ledger.balances(accounts(spark, 2), e).collect()} == {"A0": 7, "A1": 0, "S": 7}
    assert ledger.balance_of(accounts(spark, 2), e, "nobody").isEmpty()
    assert ledger.balance_of(accounts(spark, 2), e, "A1").first()["balance_minor"] == 0


def test_append_only_audit(spark):
    a = spark.createDataFrame([(1, 5), (2, 5)], "id long, x long")
    assert audit.rewritten(a, a.unionByName(spark.createDataFrame([(3, 1)], "id long, x long"))).isEmpty()
    assert audit.rewritten(a, spark.createDataFrame([(1, 6), (2, 5)], "id long, x long")).count() == 1
