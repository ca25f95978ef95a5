"""Seed accounts, and pairs of files with known discrepancies, from ``range`` and hashes: any size, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import CATEGORIES

BASE_TIME, LATER_SECONDS = "2031-02-03 04:00:00", 17
#: (code, name, type) of the accounts every ledger starts with.
SEED_ACCOUNTS = [("SETTLEMENT", "Settlement suspense", "liability"), ("FEES", "Fee income", "revenue"), ("CUST-001", "Customer 1", "asset"), ("CUST-002", "Customer 2", "asset")]


def seed_accounts(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """The seed accounts that ``existing`` lacks, to be appended; none the second time."""
    rows = spark.createDataFrame([(c, c, n, t, "NGN") for c, n, t in SEED_ACCOUNTS], "id string, code string, name string, type string, currency string")
    return rows.join(existing.select("code"), "code", "left_anti").select("id", "code", "name", "type", "currency")


def fixture(spark: SparkSession, count: int, per_category: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(internal, external) records with ``per_category`` discrepancies of each kind and ``seq`` in shuffled order."""
    kinds = [(f"{kind}/%d", kind, count if kind == "matched" else per_category) for kind in ("matched", *CATEGORIES)]

    def rows(pattern: str, kind: str, n: int) -> DataFrame:
        return spark.range(n).select(F.format_string(pattern, "id").alias("reference"), F.lit(kind).alias("kind"), F.col("id").alias("i"))

    made = [rows(*k) for k in kinds]
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    amount = F.lit(1) + F.pmod(F.xxhash64("reference", F.lit(seed), F.lit("amount")), F.lit(5_000_000))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(BASE_TIME)) + F.col("i") * 41)
    every = every.withColumn("amount", amount).withColumn("at", at)

    def records(rows: DataFrame, amount: Column, status: Column, at: Column, copy: Column) -> DataFrame:
        none = F.lit(None)
        return rows.select(
            none.cast("string").alias("transaction_id"), "reference", F.lit("CUST-001").alias("source"), F.lit("CUST-002").alias("destination"), amount.alias("amount_minor"), F.lit("NGN").alias("currency"),
            F.lit("transfer").alias("type"), status.alias("status"), at.alias("initiated_at"), none.cast("timestamp").alias("settled_at"), none.cast("map<string,string>").alias("metadata"),
            F.xxhash64("reference", F.lit(seed), copy).alias("seq"),
        )

    inside = records(every.where("kind <> 'unmatched_external'"), F.col("amount"), F.when(F.col("kind") == "pending_reversal", "failed").otherwise("settled"), F.col("at"), F.lit(0))
    out = every.where("kind not in ('unmatched_internal', 'pending_reversal')").withColumn("copy", F.explode(F.when(F.col("kind") == "duplicate", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    shown = F.col("amount") + F.when(F.col("kind") == "amount_mismatch", 7 * (F.col("i") + 3)).otherwise(F.lit(0))
    later = F.timestamp_seconds(F.unix_timestamp("at") + F.when(F.col("kind") == "unmatched_external", 0).otherwise(LATER_SECONDS))
    return inside, records(out, shown, F.lit("settled"), later, F.col("copy"))
