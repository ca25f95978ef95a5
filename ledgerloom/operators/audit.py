"""Constraints as queries: each returns the rows that break it, so an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import ACCOUNT_TYPES, CATEGORIES, DIRECTIONS, IDEMPOTENCY_STATUSES, LEDGER_STATUSES, RECORD_TYPES, RUN_STATUSES, TERMINAL


def outside(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not in a domain; null is outside as well."""
    return rows.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))


def domain_violations(accounts: DataFrame, transactions: DataFrame, entries: DataFrame) -> DataFrame:
    """(relation, id, violation) of values outside their domains and amounts that are not positive."""
    parts = [
        outside(accounts, "type", ACCOUNT_TYPES).select(F.lit("accounts").alias("relation"), F.col("id").cast("string").alias("id"), F.lit("type").alias("violation")),
        outside(transactions, "type", RECORD_TYPES).select(F.lit("transactions").alias("relation"), F.col("id").cast("string").alias("id"), F.lit("type").alias("violation")),
        outside(transactions, "status", LEDGER_STATUSES).select(F.lit("transactions").alias("relation"), F.col("id").cast("string").alias("id"), F.lit("status").alias("violation")),
        outside(entries, "direction", DIRECTIONS).select(F.lit("entries").alias("relation"), F.col("id").cast("string").alias("id"), F.lit("direction").alias("violation")),
        entries.where("not coalesce(amount_minor > 0, false)").select(F.lit("entries").alias("relation"), F.col("id").cast("string").alias("id"), F.lit("amount").alias("violation")),
    ]
    return reduce(DataFrame.unionByName, parts)


def record_domains(keys: DataFrame, runs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The same for idempotency keys, runs and exceptions: (relation, value)."""
    parts = [
        outside(keys, "status", IDEMPOTENCY_STATUSES).select(F.lit("idempotency_keys").alias("relation"), F.col("status").alias("value")),
        outside(runs, "status", RUN_STATUSES).select(F.lit("recon_runs").alias("relation"), F.col("status").alias("value")),
        outside(exceptions, "category", CATEGORIES).select(F.lit("recon_exceptions").alias("relation"), F.col("category").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once; nulls are allowed to."""
    known = rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def double_reversals(transactions: DataFrame) -> DataFrame:
    """Parents with more than one reversal."""
    return repeated(transactions.where("type = 'reversal'"), "parent_transaction_id")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference to ``parents`` leads nowhere; null leads nowhere and is allowed.

    A task holds its share of the parents' keys in memory; the rows pass by them and are not sorted.
    """
    known = parents.select(F.col(key).alias("_parent")).hint("shuffle_hash")
    return rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_parent"), "left_anti")


def fk_violations(transactions: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """(relation, id, missing) of entries without transaction or account, and transactions without their parent."""
    row = lambda df, name, what: df.select(F.lit(name).alias("relation"), F.col("id").cast("string").alias("id"), F.col(what).cast("string").alias("missing"))
    return (
        row(orphans(entries, "transaction_id", transactions), "entries.transaction", "transaction_id")
        .unionByName(row(orphans(entries, "account_id", accounts), "entries.account", "account_id"))
        .unionByName(row(orphans(transactions, "parent_transaction_id", transactions), "transactions.parent", "parent_transaction_id"))
    )


def unknown_accounts(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account codes that entries name and no account has, with the number of entries: counted before they meet the accounts."""
    return orphans(entries.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")), "account_id", accounts)


def rewritten(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that a later snapshot no longer holds as they were."""
    return before.exceptAll(after.select(*before.columns))


def currency_conflicts(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Audit: entries in another currency than their account's.

    An entry in the accounts' most common currency can conflict with accounts in the others only, so only entries in other currencies
    meet all accounts. That currency is read by the driver, one row.
    """
    a = accounts.select(F.col("id").alias("_account"), F.col("currency").alias("account_currency"))
    main = a.where("account_currency is not null").groupBy("account_currency").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "account_currency").first()
    usual = F.lit(main["account_currency"] if main else None).cast("string")
    meet = lambda e, a: e.join(a.hint("shuffle_hash"), (F.col("account_id") == F.col("_account")) & (F.col("currency") != F.col("account_currency"))).drop("_account")
    return meet(entries.where(F.col("currency") != usual), a).unionByName(meet(entries.where(F.col("currency") == usual), a.where(F.col("account_currency") != usual)))


def orphan_reversals(transfers: DataFrame, legs: DataFrame) -> DataFrame:
    """Reversed transfers without a reversal among the legs."""
    done = legs.where("type = 'reversal'").select(F.col("reference").alias("_reference"))
    return transfers.where("status = 'reversed'").join(done, F.col("reference") == F.col("_reference"), "left_anti")


def orphan_settlements(transfers: DataFrame, legs: DataFrame) -> DataFrame:
    """Settled transfers without their settlement leg."""
    keys = legs.select(F.col("idempotency_key").alias("_key"))
    return transfers.where("status = 'settled'").join(keys, F.concat(F.col("id").cast("string"), F.lit(":settle")) == F.col("_key"), "left_anti")


def double_resolved(legs: DataFrame) -> DataFrame:
    """Transfers with both a settlement and a reversal."""
    kind = F.substring_index("idempotency_key", ":", -1)
    both = legs.groupBy("transfer_id").agg(F.bool_or(kind == "settle").alias("s"), F.bool_or(kind == "reversal").alias("r"))
    return both.where("s and r").select("transfer_id")


def reversal_parents(legs: DataFrame) -> DataFrame:
    """(reversal_id, debit_id): each reversal with the debit leg that is its parent (a self-join on ids)."""
    parents = legs.where("idempotency_key like '%:debit'").select(F.col("id").alias("debit_id"), F.col("amount_minor").alias("debit_amount"))
    return legs.where("type = 'reversal'").join(parents, F.col("parent_transaction_id") == F.col("debit_id")).select(F.col("id").alias("reversal_id"), "debit_id", "amount_minor", "debit_amount")


def debit_legs(legs: DataFrame) -> DataFrame:
    return legs.where("idempotency_key like '%:debit'").agg(F.count(F.lit(1)).alias("n"))


def non_terminal(transfers: DataFrame) -> DataFrame:
    return transfers.agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("n"))
