"""The driver's tables as ledger tables. Every rule is written so that plain SQL can state it too (see ``sql.py``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import minor
from ledgerloom.functions.rail import Chaos
from ledgerloom.operators import lifecycle
from ledgerloom.spread import partitions

WINDOW_SECONDS = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(c: str) -> Column:
    return F.col(c).cast("timestamp")


def _shifted(c: Column, seconds: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(c) + F.lit(1_000_000) * seconds)


_NONE = {"transaction_id": "string", "settled_at": "timestamp", "metadata": "map<string,string>", "source": "string", "destination": "string"}


def _record(rows: DataFrame) -> DataFrame:
    for name, kind in _NONE.items():
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select("transaction_id", "reference", "source", "destination", "amount_minor", "currency", "type", "status", "initiated_at", "settled_at", "metadata", "seq")


def internal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the internal side: one in twenty is the settled reversal of the order before it."""
    k = F.col("o_orderkey")
    reversal = k % 20 == 19
    status = F.when(reversal | (F.col("o_orderstatus") == "F"), "settled").when(F.col("o_orderstatus") == "O", "failed").otherwise("timed_out")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("O-"), F.when(reversal, k - 1).otherwise(k).cast("string")).alias("reference"),
        F.when(reversal, "reversal").otherwise("transfer").alias("type"), status.alias("status"),
        minor(F.col("o_totalprice")).alias("amount_minor"), F.lit("NGN").alias("currency"), _at("o_orderdate").alias("initiated_at"), k.alias("seq"),
    )
    return _record(rows)


def external_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the external side, with other amounts, late times, repeats, gaps and strays. One scan: a row explodes to its copies."""
    k = F.col("o_orderkey")
    m = k % 10
    row = lambda prefix, extra, late, at, when: F.when(when, F.struct(F.concat(F.lit(prefix), k.cast("string")).alias("reference"), extra.cast("long").alias("extra"), late.cast("long").alias("late"), (k * 10 + at).alias("seq")))
    zero = F.lit(0)
    copies = F.array(
        row("O-", F.when(m == 1, 100 * (k % 7 + 1)).otherwise(zero), F.when(m == 3, 600).otherwise(30), 0, ~m.isin(8, 9)),
        row("O-", zero, zero, 1, m == 2),
        row("X-", zero, zero, 2, k % 25 == 0),
    )
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderdate", F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("c"))
    rows = rows.select(
        "c.reference", F.lit("transfer").alias("type"), F.lit("settled").alias("status"), (minor(F.col("o_totalprice")) + F.col("c.extra")).alias("amount_minor"), F.lit("NGN").alias("currency"),
        _shifted(_at("o_orderdate"), F.col("c.late")).alias("initiated_at"), "c.seq",
    )
    return _record(rows)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (asset), suppliers (liability), beneficiaries (asset), settlement and fees. The code is the id."""
    row = lambda df, code, kind: df.select(code.alias("id"), code.alias("code"), F.lit(kind).alias("type"), F.lit("NGN").alias("currency"))
    out = row(table(spark, sf_dir, "customer"), F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")), "asset")
    out = out.unionByName(row(table(spark, sf_dir, "supplier"), F.concat(F.lit("SUPP-"), F.col("s_suppkey").cast("string")), "liability"))
    out = out.unionByName(row(spark.range(1, 6), F.concat(F.lit("BEN-"), F.col("id").cast("string")), "asset"))
    out = out.unionByName(row(spark.range(1), F.lit("SETTLEMENT"), "liability"))
    return out.unionByName(row(spark.range(1), F.lit("FEES"), "revenue"))


def entries(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Two entries a line: debit the customer, credit the supplier. ``broken`` lines differ in amount, currency, direction or sign, some in two of them.

    Lines meet their orders by the transaction's id, so a posting's entries are together and later steps by transaction
    find them in place. Orders are never broadcast, so all sizes run in the same way, and entries come in the order of
    transactions, in which later shuffles compress better.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("transaction_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_order"), "o_custkey")
    n = partitions(line, orders)
    # The projection after the shuffle also keeps Spark from dealing both sides out anew, to the session's number of partitions.
    dealt = orders.repartition(n, "_order").select("_order", F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("_customer"))
    rows = line.repartition(n, "transaction_id").join(dealt.hint("merge"), F.col("transaction_id") == F.col("_order"))
    k = F.col("transaction_id").cast("long")
    amount = minor(F.col("l_extendedprice"))
    other, foreign, none = (k % 97 == 0, k % 89 == 0, k % 79 == 0) if broken else (F.lit(False), F.lit(False), F.lit(False))
    each = F.explode(
        F.array(
            F.struct(F.lit("debit").alias("direction"), F.col("_customer").alias("account_id"), F.when(none, 0).otherwise(amount).alias("amount_minor"), F.lit("NGN").alias("currency")),
            F.struct(
                F.when(k % 83 == 0, "sideways").otherwise("credit").alias("direction") if broken else F.lit("credit").alias("direction"),
                F.concat(F.lit("SUPP-"), F.col("l_suppkey").cast("string")).alias("account_id"),
                F.when(k % 445 == 0, 0).otherwise(amount + F.when(other, 1).otherwise(0)).alias("amount_minor") if broken else amount.alias("amount_minor"),
                F.when(foreign, "USD").otherwise("NGN").alias("currency"),
            ),
        )
    ).alias("e")
    line_id = F.concat_ws("-", "transaction_id", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), minor(F.col("l_quantity")).cast("string"), amount.cast("string"))
    rows = rows.select(line_id.alias("line_id"), "transaction_id", _at("l_shipdate").alias("created_at"), each)
    return rows.select(F.concat_ws("-", "line_id", "e.direction").alias("id"), "transaction_id", "e.account_id", "e.direction", "e.amount_minor", "e.currency", "created_at")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger transactions, some of them broken: kinds, keys, parents."""
    k = F.col("o_orderkey")
    m = k % 20
    parent = F.when(k % 500 == 19, F.lit("none")).when(m == 19, (k - 1).cast("string")).when(m == 17, (k + 1).cast("string"))
    key = F.when(k % 30 == 0, None).when(k % 45 == 1, F.concat(F.lit("K-"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("K-"), k.cast("string")))
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("O-"), k.cast("string")).alias("reference"),
        F.when(k % 77 == 0, "loan").when(m.isin(17, 19), "reversal").otherwise("transfer").alias("type"),
        F.when(k % 50 == 0, "odd").when(F.col("o_orderstatus") == "F", "settled").otherwise("pending").alias("status"),
        key.alias("idempotency_key"), parent.alias("parent_transaction_id"), _at("o_orderdate").alias("initiated_at"), F.lit(None).cast("timestamp").alias("settled_at"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfers, driven to their end by the simulated rail."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("O-"), k.cast("string")).alias("reference"), F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("BEN-"), F.substring("o_orderpriority", 1, 1)).alias("destination"), minor(F.col("o_totalprice")).alias("amount_minor"), _at("o_orderdate").alias("initiated_at"),
    )
    return lifecycle.driven(lifecycle.rail_outcomes(rows, Chaos()))


def transfers_midway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers stopped on their way: the status says where."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "debited", "in_doubt", "reversal_pending", "settled", "reversed", "failed", "manual_review")]), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("O-"), (k - k % 3).cast("string")).alias("reference"), status.alias("status"), minor(F.col("o_totalprice")).alias("amount_minor"), _at("o_orderdate").alias("initiated_at"))


def as_events(rows: DataFrame) -> DataFrame:
    """Events as steps of transfers and as requests: key, ts, event_id, target, fingerprint."""
    target = F.when(F.col("event_type") == "view", "debited").when(F.col("event_type") == "click", "settled").when(F.col("event_type") == "error", "in_doubt").when(F.col("event_type") == "purchase", "reversal_pending").when(F.col("event_type") == "signup", "reversed")
    return rows.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("key"), _at("ts").alias("ts"), "event_id", "event_type", target.alias("target"),
        F.sha2(F.col("event_type").cast("binary"), 256).alias("fingerprint"), "value", "props",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def as_outbox(rows: DataFrame) -> DataFrame:
    """Events as outbox rows: two in three are published, some of the rest are dead."""
    k = F.col("event_id")
    published = k % 3 != 0
    return rows.select(
        k.alias("id"), F.col("user_id").cast("string").alias("aggregate_id"), "event_type", F.col("props").alias("payload"), _at("ts").alias("created_at"), published.alias("published"),
        (k % 10).cast("int").alias("attempts"), F.lit(None).cast("timestamp").alias("next_attempt_at"), (~published & (k % 10 >= 8)).alias("dead_letter"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_outbox(table(spark, sf_dir, "events"))


def as_of(spark: SparkSession, sf_dir: str, hours: int = 1) -> Column:
    """The newest event's time and so many hours, as a literal (one row is read by the driver)."""
    top = table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).first()["t"] or 0
    return F.timestamp_micros(F.lit(top + hours * 3_600_000_000))
