"""The journal: posting, balances, export. Entries are appended only; balances are sums of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schemas import DIRECTIONS
from ledgerloom.spread import partitions


def account_sums(entries: DataFrame) -> DataFrame:
    """(account_id, debits, credits): conditional sums, partially aggregated, so a hot account is no hot task."""
    return entries.groupBy("account_id").agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "debit", F.col("amount_minor"))), F.lit(0)).alias("debits"),
        F.coalesce(F.sum(F.when(F.col("direction") == "credit", F.col("amount_minor"))), F.lit(0)).alias("credits"),
    )


def signed_balance(kind: Column, debits: Column, credits: Column) -> Column:
    """On the account's normal side: debits for assets and expenses, else credits."""
    return F.when(kind.isin("asset", "expense"), debits - credits).otherwise(credits - debits)


def balances(accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """(account_id, code, type, debits, credits, balance_minor) of every account; 0 without entries."""
    sums = account_sums(entries).withColumnRenamed("account_id", "_id")
    joined = accounts.join(sums, F.col("id") == F.col("_id"), "left")
    debits, credits = F.coalesce("debits", F.lit(0)), F.coalesce("credits", F.lit(0))
    return joined.select(F.col("id").alias("account_id"), "code", "type", debits.alias("debits"), credits.alias("credits"), signed_balance(F.col("type"), debits, credits).alias("balance_minor"))


def balance_of(accounts: DataFrame, entries: DataFrame, code: str) -> DataFrame:
    """The balance of one account, from its entries alone; no row for an unknown code."""
    one = accounts.where(F.col("code") == code)
    return balances(one, entries.join(F.broadcast(one.select(F.col("id").alias("_one")).limit(1)), F.col("account_id") == F.col("_one"), "left_semi"))


def refreshed_cache(cache: DataFrame, entries: DataFrame, accounts: DataFrame, posted: DataFrame) -> DataFrame:
    """The cached balances after a batch of postings: touched accounts are summed anew, the others kept.

    A full-refresh upsert for files: overwrite the cache with it.
    """
    touched = posted.select("account_id").distinct()
    fresh = balances(accounts, entries.join(touched, "account_id", "left_semi")).join(touched, "account_id", "left_semi").select("account_id", "balance_minor")
    return cache.select("account_id", "balance_minor").join(touched, "account_id", "left_anti").unionByName(fresh)


def totals(entries: DataFrame) -> DataFrame:
    """(debits, credits) over all entries; other directions are in neither."""
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount_minor"))), F.lit(0))
    return entries.agg(total("debit").alias("debits"), total("credit").alias("credits"))


def unbalanced(entries: DataFrame, by_currency: bool = True) -> DataFrame:
    """(transaction_id, difference) where debits and credits differ: per currency, or blind to it."""
    signed = F.when(F.col("direction") == "debit", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    if not by_currency:
        return entries.groupBy("transaction_id").agg(F.sum(signed).alias("difference")).where("difference <> 0")
    parts = entries.groupBy("transaction_id", "currency").agg(F.sum(signed).alias("d")).where("d <> 0")
    return parts.groupBy("transaction_id").agg(F.sum(F.abs("d")).alias("difference"))


def posting_errors(entries: DataFrame, accounts: DataFrame | None = None, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(transaction_id, error) of every posting; error is null for a valid one.

    Fewer than two entries come first. Then entries are looked at in their order: the first whose currency is not
    the first entry's, or whose amount is not positive, decides. Then a direction that is none, debits other than
    credits, and, with ``accounts``, an unknown account. Entries are not gathered: a posting's rows are reduced by
    currency first, then over its currencies.
    """
    signed = F.when(F.col("direction") == "debit", F.col("amount_minor")).when(F.col("direction") == "credit", -F.col("amount_minor")).otherwise(F.lit(0))
    rows = entries
    unknown = F.lit(False)
    if accounts is not None:
        rows = rows.join(accounts.select(F.col("id").alias("_known")), F.col("account_id") == F.col("_known"), "left")
        unknown = F.bool_or(F.col("_known").isNull())
    at = F.struct(*order)
    parts = rows.groupBy("transaction_id", "currency").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(at).alias("begins"),
        F.min(F.when(F.coalesce(F.col("amount_minor") <= 0, F.lit(True)), at)).alias("low"),
        F.bool_and(F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False))).alias("directed"),
        F.sum(signed).alias("difference"),
        unknown.alias("unknown"),
    )
    checks = parts.groupBy("transaction_id").agg(
        F.sum("n").alias("n"),
        F.get(F.sort_array(F.collect_list("begins")), F.lit(1)).alias("other"),  # where a second currency begins
        F.min("low").alias("low"),
        F.bool_and("directed").alias("directed"),
        F.sum("difference").alias("difference"),
        F.bool_or("unknown").alias("unknown"),
    )
    error = (
        F.when(F.col("n") < 2, "too_few_entries")
        .when(F.col("other").isNotNull() & F.coalesce(F.col("other") <= F.col("low"), F.lit(True)), "currency_mismatch")
        .when(F.col("low").isNotNull(), "non_positive_amount")
        .when(~F.col("directed"), "invalid_direction")
        .when(F.col("difference") != 0, "unbalanced")
        .when(F.col("unknown"), "unknown_account")
    )
    return checks.select("transaction_id", error.alias("error"))


def post(requests: DataFrame, entries: DataFrame, accounts: DataFrame, posted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, entries, rejected) that a batch of postings appends.

    A key that was posted before, or came earlier in the batch (by ``seq``), is a replay and appends nothing. Invalid
    postings are rejected whole.
    """
    first = Window.partitionBy("idempotency_key").orderBy("seq")
    ranked = requests.withColumn("_n", F.when(F.col("idempotency_key").isNull(), 1).otherwise(F.row_number().over(first)))
    fresh = ranked.where("_n = 1").drop("_n").join(posted.where("idempotency_key is not null").select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    errors = posting_errors(entries, accounts)
    found = F.when(F.col("transaction_id").isNull(), "too_few_entries").otherwise(F.col("error"))
    judged = fresh.join(errors, fresh["id"] == errors["transaction_id"], "left").withColumn("error", found).drop("transaction_id")
    good = judged.where("error is null").drop("error")
    return good, entries.join(good.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi"), judged.where("error is not null").select("id", "idempotency_key", "error")


def export(transactions: DataFrame, entries: DataFrame, accounts: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Canonical records of the transactions initiated in [start, end), in no order (see ``export_order``).

    The amount is the sum of the debits; destination is the first debited account and source the first
    credited one, by (created_at, id). With a window, only its transactions' entries are joined with accounts and aggregated.
    Entries that are dealt out by transaction stay where they are until those of one transaction, account and direction are
    one row; only these rows move, once to the accounts and once back, then in partitions of a fixed share. No join sorts
    the entries, and none becomes a broadcast join where tables are small.
    """
    rows = transactions
    if start is not None:
        rows = rows.where(F.col("initiated_at") >= start)
    if end is not None:
        rows = rows.where(F.col("initiated_at") < end)
    n = partitions(entries, accounts)
    if start is not None or end is not None:
        entries = entries.join(rows.select(F.col("id").alias("_wanted")).hint("shuffle_hash"), F.col("transaction_id") == F.col("_wanted"), "left_semi")
    at = F.struct("created_at", "id")
    debit, credit = F.col("direction") == "debit", F.col("direction") == "credit"
    sums = entries.groupBy("transaction_id", "account_id", "direction").agg(
        F.sum(F.when(debit, F.col("amount_minor"))).alias("_sum"), F.min(at).alias("_at"), F.min_by("currency", at).alias("_first_currency")
    )
    coded = sums.join(accounts.select(F.col("id").alias("_account"), "code").hint("shuffle_hash"), F.col("account_id") == F.col("_account"))
    sides = coded.drop("account_id", "_account").repartition(n, "transaction_id").groupBy("transaction_id").agg(
        F.sum("_sum").alias("_amount"),
        F.min_by(F.when(debit, F.col("code")), F.when(debit, F.col("_at"))).alias("_debited"),
        F.min_by(F.when(credit, F.col("code")), F.when(credit, F.col("_at"))).alias("_credited"),
        F.min_by("_first_currency", "_at").alias("_currency"),
    )
    joined = rows.join(sides.hint("merge"), rows["id"] == sides["transaction_id"], "left")
    return joined.select(
        F.col("id").alias("transaction_id"), "reference", F.coalesce("_credited", F.lit("")).alias("source"), F.coalesce("_debited", F.lit("")).alias("destination"),
        F.coalesce("_amount", F.lit(0)).alias("amount_minor"), F.coalesce("_currency", F.lit("")).alias("currency"), "type", "status", "initiated_at", "settled_at", "metadata",
    )


def export_order(records: DataFrame) -> DataFrame:
    return records.orderBy("initiated_at", "transaction_id")


def journal_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("created_at", "id")


def running_balances(accounts: DataFrame, entries: DataFrame, every: str = "month") -> DataFrame:
    """Each entry with its account's balance after it (an audit aid).

    Entries are dealt out once, by account and period, and summed inside periods; a period's last sum is its total. The totals,
    at most one row a period and account, meet the accounts and are summed up apart. So an account of a third of all entries
    is as many tasks' work as there are periods, and the entries themselves move no more for the accounts' types or the openings.
    """
    debit, credit = F.when(F.col("direction") == "debit", F.col("amount_minor")).otherwise(F.lit(0)), F.when(F.col("direction") == "credit", F.col("amount_minor")).otherwise(F.lit(0))
    period = F.coalesce(F.date_trunc(every, "created_at"), F.lit("0001-01-01").cast("timestamp"))
    rows = entries.select("id", "account_id", "created_at", period.alias("_period"), (debit - credit).alias("_x"))
    inside = Window.partitionBy("account_id", "_period").orderBy("created_at", "id")
    upto = rows.repartition(partitions(entries, accounts), "account_id", "_period").withColumn("_inside", F.sum("_x").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # The same shuffle serves both: the totals are rows of what is summed already, not another aggregate of the entries.
    totals = upto.withColumn("_next", F.lead(F.lit(1)).over(inside)).where("_next is null").select("account_id", "_period", F.col("_inside").alias("_total"))
    before = Window.partitionBy("account_id").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    known = totals.join(accounts.select(F.col("id").alias("_account"), "type").hint("shuffle_hash"), F.col("account_id") == F.col("_account"))
    opened = known.select("account_id", "_period", "type", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_opening"))
    joined = upto.join(opened.hint("merge"), ["account_id", "_period"])
    return joined.select("id", "account_id", "created_at", signed_balance(F.col("type"), F.col("_opening") + F.col("_inside"), F.lit(0)).alias("balance_minor"))


def conservation(accounts: DataFrame, entries: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The sum of all balances (of accounts of some types): it does not change as value moves among them."""
    rows = balances(accounts, entries)
    return (rows.where(F.col("type").isin(*kinds)) if kinds else rows).agg(F.coalesce(F.sum("balance_minor"), F.lit(0)).alias("total_minor"))
