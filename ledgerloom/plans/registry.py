"""All queries of the ledger and reconciliation operators: name -> (DataFrame, SQL or None)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.functions.rail import u01
from ledgerloom.operators import audit, ledger, lifecycle, outbox, reconcile, requests
from ledgerloom.plans import sql as S
from ledgerloom.plans import tables as D
from ledgerloom.sources import adapters, generate, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; only in local mode may none be named, then it is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "ledgerloom")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def us(c: str):
    return F.unix_micros(c)


# ---------------------------------------------------------------- reconciliation


def classified(spark: SparkSession, d: str, window: float = D.WINDOW_SECONDS) -> DataFrame:
    return reconcile.classify(D.internal_records(spark, d), D.external_records(spark, d), window)


@query(f"SELECT category, count(*) AS n, CAST(coalesce(sum(delta_minor), 0) AS BIGINT) AS delta_minor FROM {S.classified()} GROUP BY category")
def recon_summary(spark, d):
    return reconcile.summary(classified(spark, d))


@query(f"SELECT category, reference, delta_minor, reason FROM {S.classified()} WHERE category <> 'matched'")
def recon_exceptions(spark, d):
    return reconcile.in_report_order(reconcile.exceptions(classified(spark, d))).select("category", "reference", "delta_minor", "reason")


@query(f"SELECT reference, internal_minor AS amount_minor FROM {S.classified()} WHERE category = 'matched'")
def recon_matched(spark, d):
    return classified(spark, d).where("category = 'matched'").select("reference", F.col("internal.amount_minor").alias("amount_minor"))


@query(f"SELECT count(*) FILTER (category = 'matched') AS matched_count, count(*) FILTER (category <> 'matched') AS exception_count FROM {S.classified()}")
def recon_counts(spark, d):
    return reconcile.counts(classified(spark, d))


def _category(name: str, side: str) -> None:
    def run(spark, d):
        return classified(spark, d).where(F.col("category") == name).select("reference", F.col(f"{side}.amount_minor").alias("amount_minor"), F.col(f"{side}.status").alias("status"), "delta_minor")

    QUERIES[f"recon_{name}"] = (run, f"SELECT reference, {side}_minor AS amount_minor, {side}_status AS status, delta_minor FROM {S.classified()} WHERE category = '{name}'")


for _name, _side in (("duplicate", "external"), ("unmatched_internal", "internal"), ("unmatched_external", "external"), ("amount_mismatch", "internal"), ("pending_reversal", "internal")):
    _category(_name, _side)

SWEEP = (0, 30, 120, 600)


@query(" UNION ALL ".join(f"SELECT {w} AS window_seconds, category, count(*) AS n FROM {S.classified(w * 1_000_000)} GROUP BY category" for w in SWEEP))
def recon_window_sweep(spark, d):
    # The windows explode after the join, so the sides are read and joined once.
    rows = classified(spark, d, 0).select("category", F.abs(us("internal.initiated_at") - us("external.initiated_at")).alias("gap"), F.explode(F.array(*[F.lit(w) for w in SWEEP])).alias("window_seconds"))
    late = (F.col("category") == "matched") & (F.col("window_seconds") > 0) & (F.col("gap") > F.col("window_seconds") * F.lit(1_000_000).cast("long"))
    return rows.groupBy("window_seconds", F.when(late, "amount_mismatch").otherwise(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT reference FROM {S.INTERNAL} WHERE type = 'reversal' AND status = 'settled'")
def settled_reversals(spark, d):
    return reconcile.settled_reversals(D.internal_records(spark, d))


@query(f"SELECT reference, count(*) AS n FROM (SELECT * REPLACE ('R-' || (seq - seq % 3) AS reference) FROM {S.INTERNAL}) WHERE type <> 'reversal' GROUP BY reference HAVING count(*) > 1")
def recon_internal_duplicates(spark, d):
    rows = D.internal_records(spark, d).withColumn("reference", F.concat(F.lit("R-"), (F.col("seq") - F.col("seq") % 3).cast("string")))
    return reconcile.internal_duplicates(rows)


@query(f"SELECT reference, internal_status, external_status FROM {S.classified()} WHERE category = 'matched' AND internal_status <> external_status")
def recon_status_conflicts(spark, d):
    return reconcile.status_conflicts(classified(spark, d))


@query(f"SELECT reference, internal_minor AS amount_minor, 'NGN' AS currency, 'reverse' AS action FROM {S.classified()} WHERE category = 'pending_reversal'")
def recon_corrective_requests(spark, d):
    return reconcile.corrective_requests(classified(spark, d))


@query(f"SELECT count(*) FILTER (t.reference IS NOT NULL) AS sent, count(*) FILTER (t.reference IS NULL) AS failed FROM {S.classified()} c LEFT JOIN (SELECT DISTINCT reference FROM {S.MIDWAY}) t ON c.reference = t.reference WHERE c.category = 'pending_reversal'")
def recon_feedback_tally(spark, d):
    return reconcile.feedback_tally(reconcile.corrective_requests(classified(spark, d)), D.transfers_midway(spark, d))


_DETAIL = f"""CASE WHEN category = 'amount_mismatch' THEN ' internal=' || {S.FORMATTED.format("internal_minor")} || ' external=' || {S.FORMATTED.format("external_minor")} || ' delta=' || printf('%+d', coalesce(delta_minor, 0))
  WHEN category IN ('pending_reversal', 'unmatched_internal') THEN ' amount=' || {S.FORMATTED.format("internal_minor")} || ' status=' || internal_status
  ELSE ' amount=' || {S.FORMATTED.format("external_minor")} || ' status=' || external_status END"""


@query(f"SELECT '  [' || category || '] ref=' || reference || {_DETAIL} AS line FROM {S.classified()} WHERE category <> 'matched'")
def recon_report_lines(spark, d):
    return sinks.report_lines(classified(spark, d)).select("line")


@query(f"SELECT count(*) FILTER (category = 'matched') AS matched, count(*) FILTER (category = 'duplicate') AS duplicate, count(*) FILTER (category = 'unmatched_external') AS unmatched_external FROM {S.classified()}")
def recon_summary_json(spark, d):
    s = reconcile.summary_json(classified(spark, d), "abc")
    at = lambda p: F.get_json_object("summary", p).cast("long")
    return s.select(at("$.matched").alias("matched"), at("$.by_category.duplicate").alias("duplicate"), at("$.by_category.unmatched_external").alias("unmatched_external"))


@query("""SELECT category, n FROM (VALUES ('matched', 1010), ('amount_mismatch', 10), ('unmatched_internal', 10), ('unmatched_external', 10), ('duplicate', 10), ('pending_reversal', 10)) t(category, n)""")
def fixture_recall(spark, d):
    inside, outside = generate.fixture(spark, 1000, 10, 42)
    return reconcile.summary(reconcile.classify(inside, outside, 120)).select("category", F.col("n").cast("int").alias("n"))


# ---------------------------------------------------------------- ledger


@query(f"SELECT * FROM {S.SUMS}")
def account_sums(spark, d):
    return ledger.account_sums(D.entries(spark, d))


@query(f"SELECT account_id, type, debits, credits, balance_minor FROM {S.BALANCES}")
def account_balances(spark, d):
    return ledger.balances(D.accounts(spark, d), D.entries(spark, d)).drop("code")


@query(f"SELECT type, count(*) AS n, CAST(sum(balance_minor) AS BIGINT) AS balance_minor FROM {S.BALANCES} GROUP BY type")
def account_balance_by_type(spark, d):
    return ledger.balances(D.accounts(spark, d), D.entries(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("balance_minor").alias("balance_minor"))


@query(f"SELECT account_id, balance_minor FROM {S.BALANCES} WHERE account_id = 'CUST-1'")
def balance_of_account(spark, d):
    return ledger.balance_of(D.accounts(spark, d), D.entries(spark, d), "CUST-1").select("account_id", "balance_minor")


@query(f"SELECT account_id, CASE WHEN account_id IN (SELECT account_id FROM {S.entries()} WHERE CAST(transaction_id AS BIGINT) % 100 = 0) THEN balance_minor ELSE CAST(0 AS BIGINT) END AS balance_minor FROM {S.BALANCES}")
def cached_balance_refresh(spark, d):
    a, e = D.accounts(spark, d), D.entries(spark, d)
    cache = a.select(F.col("id").alias("account_id"), F.lit(0).cast("long").alias("balance_minor"))
    return ledger.refreshed_cache(cache, e, a, e.where(F.col("transaction_id").cast("long") % 100 == 0))


@query(f"SELECT id, type FROM {S.ACCOUNTS} WHERE id IN ('SETTLEMENT', 'FEES', 'CUST-5')")
def account_lookup(spark, d):
    return D.accounts(spark, d).where(F.col("code").isin("SETTLEMENT", "FEES", "CUST-5")).select("id", "type")


@query(f"SELECT CAST(sum(amount_minor) FILTER (direction = 'debit') AS BIGINT) AS debits, CAST(sum(amount_minor) FILTER (direction = 'credit') AS BIGINT) AS credits FROM {S.entries(True)}")
def request_totals(spark, d):
    return ledger.totals(D.entries(spark, d, broken=True))


_SIGNED = "CASE WHEN direction = 'debit' THEN amount_minor ELSE -amount_minor END"


@query(f"SELECT transaction_id, CAST(sum(abs(x)) AS BIGINT) AS difference FROM (SELECT transaction_id, currency, sum({_SIGNED}) AS x FROM {S.entries(True)} GROUP BY transaction_id, currency) WHERE x <> 0 GROUP BY transaction_id")
def balance_check_currency(spark, d):
    return ledger.unbalanced(D.entries(spark, d, broken=True))


@query(f"SELECT transaction_id, CAST(sum({_SIGNED}) AS BIGINT) AS difference FROM {S.entries(True)} GROUP BY transaction_id HAVING sum({_SIGNED}) <> 0")
def balance_check_blind(spark, d):
    return ledger.unbalanced(D.entries(spark, d, broken=True), by_currency=False)


@query(f"SELECT CAST(sum(balance_minor) AS BIGINT) AS total_minor FROM {S.BALANCES} WHERE type = 'asset'")
def conservation_total(spark, d):
    return ledger.conservation(D.accounts(spark, d), D.entries(spark, d), ("asset",))


_EXPORT = f"""SELECT t.id AS transaction_id, t.reference, coalesce(s.credited, '') AS source, coalesce(s.debited, '') AS destination, CAST(coalesce(s.amount, 0) AS BIGINT) AS amount_minor, t.type, t.status, t.tus AS initiated_us
FROM {S.TRANSACTIONS} t LEFT JOIN (SELECT transaction_id, sum(amount_minor) FILTER (direction = 'debit') AS amount, arg_min(account_id, row(tus, id)) FILTER (direction = 'debit') AS debited,
  arg_min(account_id, row(tus, id)) FILTER (direction = 'credit') AS credited FROM {S.entries()} GROUP BY transaction_id) s ON t.id = s.transaction_id"""


@query(f"{_EXPORT} WHERE t.tus >= epoch_us(TIMESTAMP '1995-01-01') AND t.tus < epoch_us(TIMESTAMP '1997-01-01')")
def export_window(spark, d):
    rows = ledger.export(D.transactions(spark, d), D.entries(spark, d), D.accounts(spark, d), F.lit("1995-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))
    return ledger.export_order(rows).select("transaction_id", "reference", "source", "destination", "amount_minor", "type", "status", us("initiated_at").alias("initiated_us"))


@query(f"SELECT count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM ({_EXPORT})")
def export_totals(spark, d):
    return ledger.export(D.transactions(spark, d), D.entries(spark, d), D.accounts(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"))


@query(f"SELECT id, transaction_id, direction, amount_minor, tus AS created_us FROM {S.entries()} WHERE account_id = 'SUPP-7'")
def entries_by_account(spark, d):
    return ledger.journal_order(D.entries(spark, d).where("account_id = 'SUPP-7'")).select("id", "transaction_id", "direction", "amount_minor", us("created_at").alias("created_us"))


@query(f"SELECT id, account_id, direction, amount_minor FROM {S.entries()} WHERE transaction_id IN ('1', '2', '3')")
def entries_by_transaction(spark, d):
    return ledger.journal_order(D.entries(spark, d).where(F.col("transaction_id").isin("1", "2", "3"))).select("id", "account_id", "direction", "amount_minor")


@query(f"SELECT id, account_id, CAST(sum(CASE WHEN (type = 'asset') = (direction = 'debit') THEN amount_minor ELSE -amount_minor END) OVER (PARTITION BY account_id ORDER BY tus, e.id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_minor FROM {S.entries()} e JOIN (SELECT id AS a, type FROM {S.ACCOUNTS}) ON account_id = a")
def running_balance(spark, d):
    return ledger.running_balances(D.accounts(spark, d), D.entries(spark, d)).drop("created_at")


@query(f"""WITH e AS (SELECT *, row_number() OVER o AS rn, first_value(currency) OVER o AS head FROM {S.entries(True)} WINDOW o AS (PARTITION BY transaction_id ORDER BY tus, id))
SELECT transaction_id, CASE WHEN n < 2 THEN 'too_few_entries' WHEN mixed <= coalesce(low, mixed) THEN 'currency_mismatch' WHEN low IS NOT NULL THEN 'non_positive_amount' WHEN NOT directed THEN 'invalid_direction' WHEN x <> 0 THEN 'unbalanced' WHEN gone THEN 'unknown_account' END AS error
FROM (SELECT transaction_id, count(*) AS n, min(rn) FILTER (currency <> head) AS mixed, min(rn) FILTER (amount_minor <= 0) AS low, bool_and(direction IN ('debit', 'credit')) AS directed,
  sum(CASE direction WHEN 'debit' THEN amount_minor WHEN 'credit' THEN -amount_minor ELSE 0 END) AS x, bool_or(a IS NULL) AS gone
  FROM e LEFT JOIN (SELECT id AS a FROM {S.ACCOUNTS} WHERE id <> 'SUPP-3') ON account_id = a GROUP BY transaction_id)""")
def posting_validation(spark, d):
    return ledger.posting_errors(D.entries(spark, d, broken=True), D.accounts(spark, d).where("id <> 'SUPP-3'"))


_POSTED = f"""(SELECT * FROM {S.TRANSACTIONS} WHERE idempotency_key IS NULL OR CAST(id AS BIGINT) % 11 <> 0 QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY CAST(id AS BIGINT)) = 1)"""


@query(f"""SELECT CASE WHEN e.n IS NULL THEN 'too_few_entries' WHEN e.x <> 0 THEN 'unbalanced' WHEN e.mixed THEN 'currency_mismatch' WHEN NOT e.directed THEN 'invalid_direction' ELSE 'posted' END AS outcome, count(*) AS n
FROM {S.TRANSACTIONS} t LEFT JOIN (SELECT transaction_id, count(*) AS n, 0 AS x, min(currency) <> max(currency) AS mixed, bool_and(direction IN ('debit', 'credit')) AS directed FROM {S.entries()} GROUP BY transaction_id) e ON t.id = e.transaction_id
WHERE t.id IN (SELECT id FROM {S.TRANSACTIONS} WHERE idempotency_key IS NULL OR idempotency_key NOT IN (SELECT 'K-' || o_orderkey FROM orders WHERE o_orderkey % 11 = 0) QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY CAST(id AS BIGINT)) = 1)
GROUP BY 1""")
def posting_batch(spark, d):
    t = D.transactions(spark, d).withColumn("seq", F.col("id").cast("long"))
    known = D.table(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.concat(F.lit("K-"), F.col("o_orderkey").cast("string")).alias("idempotency_key"))
    good, _, bad = ledger.post(t, D.entries(spark, d), D.accounts(spark, d), known)
    return good.select(F.lit("posted").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- constraints and audits


@query(f"SELECT account_id, count(*) AS n FROM {S.entries()} WHERE account_id NOT IN (SELECT id FROM {S.ACCOUNTS} WHERE id <> 'SUPP-3' AND id <> 'CUST-7') GROUP BY account_id")
def unknown_accounts(spark, d):
    return audit.unknown_accounts(D.entries(spark, d), D.accounts(spark, d).where("id <> 'SUPP-3' and id <> 'CUST-7'"))


@query(f"""SELECT 'entries.transaction' AS relation, id, transaction_id AS missing FROM {S.entries()} WHERE CAST(transaction_id AS BIGINT) % 1000 = 1
UNION ALL SELECT 'entries.account', id, account_id FROM {S.entries()} WHERE account_id = 'SUPP-3'
UNION ALL SELECT 'transactions.parent', id, parent_transaction_id FROM {S.TRANSACTIONS} WHERE parent_transaction_id IS NOT NULL AND CAST(id AS BIGINT) % 1000 <> 1
  AND parent_transaction_id NOT IN (SELECT id FROM {S.TRANSACTIONS} WHERE CAST(id AS BIGINT) % 1000 <> 1)""")
def fk_violations(spark, d):
    kept = D.transactions(spark, d).where("cast(id as bigint) % 1000 <> 1")
    return audit.fk_violations(kept, D.entries(spark, d), D.accounts(spark, d).where("id <> 'SUPP-3'"))


@query(f"""SELECT 'transactions' AS relation, id, 'type' AS violation FROM {S.TRANSACTIONS} WHERE type NOT IN ('transfer', 'reversal', 'fee')
UNION ALL SELECT 'transactions', id, 'status' FROM {S.TRANSACTIONS} WHERE status = 'odd'
UNION ALL SELECT 'entries', id, 'direction' FROM {S.entries(True)} WHERE direction = 'sideways'
UNION ALL SELECT 'entries', id, 'amount' FROM {S.entries(True)} WHERE amount_minor <= 0""")
def domain_violations(spark, d):
    return audit.domain_violations(D.accounts(spark, d), D.transactions(spark, d), D.entries(spark, d, broken=True))


@query("SELECT * FROM (VALUES ('idempotency_keys', 'gone'), ('recon_exceptions', 'odd'), ('recon_runs', 'paused')) t(relation, value)")
def record_domains(spark, d):
    one = lambda v, c: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in v])).alias(c))
    return audit.record_domains(one(("in_progress", "gone"), "status"), one(("completed", "paused"), "status"), one(("duplicate", "odd"), "category"))


@query(f"SELECT idempotency_key, count(*) AS n FROM {S.TRANSACTIONS} WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return audit.repeated(D.transactions(spark, d), "idempotency_key")


@query(f"SELECT parent_transaction_id, count(*) AS n FROM {S.TRANSACTIONS} WHERE type = 'reversal' AND parent_transaction_id IS NOT NULL GROUP BY parent_transaction_id HAVING count(*) > 1")
def double_reversal(spark, d):
    return audit.double_reversals(D.transactions(spark, d))


@query(f"SELECT id, currency, 'NGN' AS account_currency FROM {S.entries(True)} WHERE currency <> 'NGN'")
def currency_conflicts(spark, d):
    return audit.currency_conflicts(D.entries(spark, d, broken=True), D.accounts(spark, d)).select("id", "currency", "account_currency")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 1 AS was FROM orders WHERE o_orderkey % 100 = 0")
def journal_rewrites(spark, d):
    before = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).alias("was"))
    after = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 100 == 0, 2).otherwise(1).alias("was"))
    return audit.rewritten(before, after)


# ---------------------------------------------------------------- rail, transfers, legs


@query(f"""SELECT reference, send_timeout, declined, duplicate, tsq_timeout, CASE WHEN send_timeout THEN 'unknown' WHEN declined THEN 'declined' ELSE 'success' END AS send_verdict,
CASE WHEN tsq_timeout THEN 'unknown' WHEN declined THEN 'declined' ELSE 'success' END AS query_verdict, status AS terminal, CASE WHEN NOT send_timeout AND NOT declined AND duplicate THEN 2 ELSE 0 END AS callbacks FROM {S.TRANSFERS}""")
def rail_outcomes(spark, d):
    return D.transfers(spark, d).select("reference", "send_timeout", "declined", "duplicate", "tsq_timeout", "send_verdict", "query_verdict", "terminal", "callbacks")


@query(f"SELECT o_orderkey AS id, round({S.u01('reference', 'decline')}, 9) AS drawn FROM (SELECT o_orderkey, 'O-' || o_orderkey AS reference FROM orders)")
def rail_draws(spark, d):
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(u01(42, F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")), "decline"), 9).alias("drawn"))


@query(f"SELECT status, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM {S.TRANSFERS} GROUP BY status")
def outcome_split(spark, d):
    return lifecycle.outcome_split(D.transfers(spark, d))


@query(f"SELECT id, status AS terminal, upper(status) AS state FROM {S.TRANSFERS}")
def predicted_terminal(spark, d):
    # The fold over the steps must end where the three draws say.
    return D.transfers(spark, d).select("id", F.when(F.col("status") == F.col("terminal"), F.col("terminal")).alias("terminal"), "state")


@query(f"SELECT transfer_id, reference, amount_minor, idempotency_key, type, debit_account, credit_account, parent_transaction_id FROM {S.LEGS}")
def transfer_legs(spark, d):
    return lifecycle.legs(D.transfers(spark, d)).drop("id")


@query(f"SELECT debit_account AS account_id, CAST(sum(amount_minor) AS BIGINT) AS debited FROM {S.LEGS} GROUP BY 1")
def leg_entry_debits(spark, d):
    e = lifecycle.leg_entries(lifecycle.legs(D.transfers(spark, d))).where("direction = 'debit'")
    return e.groupBy("account_id").agg(F.sum("amount_minor").alias("debited"))


@query(f"SELECT CAST(sum(amount_minor) AS BIGINT) AS held_minor FROM {S.TRANSFERS} WHERE status = 'manual_review'")
def suspense_balance(spark, d):
    a = D.accounts(spark, d).where("code = 'SETTLEMENT'")
    return ledger.balances(a, lifecycle.leg_entries(lifecycle.legs(D.transfers(spark, d))).where("account_id = 'SETTLEMENT'")).select(F.col("balance_minor").alias("held_minor"))


@query(f"SELECT id FROM {S.TRANSFERS} WHERE status = 'reversed' AND id % 7 = 0")
def orphan_reversals(spark, d):
    t = D.transfers(spark, d)
    return audit.orphan_reversals(t, lifecycle.legs(t).where("not (type = 'reversal' and transfer_id % 7 = 0)")).select("id")


@query(f"SELECT id FROM {S.TRANSFERS} WHERE status = 'settled' AND id % 7 = 0")
def orphan_settlements(spark, d):
    t = D.transfers(spark, d)
    return audit.orphan_settlements(t, lifecycle.legs(t).where("not (idempotency_key like '%:settle' and transfer_id % 7 = 0)")).select("id")


@query(f"SELECT id AS transfer_id FROM {S.TRANSFERS} WHERE status = 'reversed' AND id % 9 = 0")
def double_resolved(spark, d):
    legs = lifecycle.legs(D.transfers(spark, d))
    extra = legs.where("type = 'reversal' and transfer_id % 9 = 0").withColumn("idempotency_key", F.concat(F.col("transfer_id").cast("string"), F.lit(":settle")))
    return audit.double_resolved(legs.unionByName(extra))


@query(f"SELECT id || ':reversal' AS reversal_id, id || ':debit' AS debit_id, amount_minor, amount_minor AS debit_amount FROM {S.TRANSFERS} WHERE status = 'reversed'")
def reversal_parents(spark, d):
    return audit.reversal_parents(lifecycle.legs(D.transfers(spark, d)))


@query("SELECT count(*) AS n FROM orders")
def debit_leg_count(spark, d):
    return audit.debit_legs(lifecycle.legs(D.transfers(spark, d)))


# ---------------------------------------------------------------- lifecycle and requests


@query(f"SELECT key, status, n_events FROM {S.FOLD}")
def lifecycle_fold(spark, d):
    return lifecycle.fold_events(D.events(spark, d))


@query(f"SELECT count(*) FILTER (status NOT IN ({S.TERMINALS})) AS n FROM {S.FOLD}")
def nonterminal_count(spark, d):
    return audit.non_terminal(lifecycle.fold_events(D.events(spark, d)))


@query(f"SELECT key, event_id, event_type FROM {S.EVENTS} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1")
def last_events(spark, d):
    return lifecycle.last_events(D.events(spark, d)).select("key", "event_id", "event_type")


_LIVE = f"(SELECT aggregate_id FROM {S.OUTBOX} WHERE NOT published AND NOT dead_letter)"


@query(f"SELECT id, status FROM {S.MIDWAY} WHERE status NOT IN ({S.TERMINALS}) AND CAST(id AS VARCHAR) NOT IN {_LIVE}")
def stuck_transfers(spark, d):
    return lifecycle.stuck(D.transfers_midway(spark, d), D.outbox(spark, d)).select("id", "status")


@query(f"SELECT id, status, tus AS initiated_us FROM {S.MIDWAY} WHERE status IN ('pending', 'debited', 'in_doubt', 'reversal_pending')")
def resumable_transfers(spark, d):
    return lifecycle.resumable(D.transfers_midway(spark, d)).select("id", "status", us("initiated_at").alias("initiated_us"))


@query(f"SELECT CAST(id AS VARCHAR) AS aggregate_id, CASE status WHEN 'pending' THEN 'debit_requested' WHEN 'debited' THEN 'debited' WHEN 'in_doubt' THEN 'in_doubt' ELSE 'reversal_requested' END AS event_type FROM {S.MIDWAY} WHERE status NOT IN ({S.TERMINALS}) AND CAST(id AS VARCHAR) NOT IN {_LIVE}")
def recovery_events(spark, d):
    return lifecycle.recovery_events(lifecycle.stuck(D.transfers_midway(spark, d), D.outbox(spark, d)))


_LATEST = f"(SELECT * FROM {S.MIDWAY} QUALIFY row_number() OVER (PARTITION BY reference ORDER BY tus DESC, id DESC) = 1)"


@query(f"SELECT reference, id, status FROM {_LATEST}")
def latest_by_reference(spark, d):
    return lifecycle.latest_by_reference(D.transfers_midway(spark, d)).select("reference", "id", "status")


@query(f"SELECT CAST(id AS VARCHAR) AS aggregate_id, 'reversal_requested' AS event_type FROM {_LATEST} WHERE status = 'reversal_pending'")
def requeued_reversals(spark, d):
    t = D.transfers_midway(spark, d)
    return lifecycle.requeued_reversals(t, t.select("reference"))


_CALLED = "CASE id % 4 WHEN 0 THEN 'settled' WHEN 1 THEN 'reversal_pending' END"


@query(f"SELECT id, CASE WHEN {S.LEGAL.replace('(s =', '(status =').replace(' t IN', f' {_CALLED} IN')} THEN {_CALLED} ELSE status END AS status FROM (SELECT * REPLACE ('T-' || id AS reference) FROM {S.MIDWAY})")
def callback_outcomes(spark, d):
    t = D.transfers_midway(spark, d).withColumn("reference", F.concat(F.lit("T-"), F.col("id").cast("string")))
    verdict = F.when(F.col("id") % 4 == 0, "success").when(F.col("id") % 4 == 1, "declined").otherwise("unknown")
    calls = t.select("reference", verdict.alias("verdict"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return lifecycle.apply_callbacks(t, calls).select("id", "status")


@query(f"SELECT id, CASE WHEN status = 'pending' THEN 'DEBIT_PENDING' ELSE upper(status) END AS state, status FROM {S.MIDWAY}")
def state_mapping(spark, d):
    state = lifecycle.state_of_status(F.col("status"))
    return D.transfers_midway(spark, d).select("id", state.alias("state"), lifecycle.status_of_state(state).alias("status"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'missing_field' WHEN o_orderkey % 7 = 0 THEN 'unsupported_currency' WHEN o_orderkey % 5 = 0 THEN 'non_positive_amount' END AS error FROM orders""")
def request_validation(spark, d):
    k = F.col("o_orderkey")
    error = requests.request_error(F.when(k % 13 == 0, "").otherwise("A"), F.lit("B"), F.when(k % 5 == 0, 0).otherwise(10), F.when(k % 7 == 0, "USD").otherwise("NGN"), F.lit("R"))
    return D.table(spark, d, "orders").select(k.alias("id"), error.alias("error"))


_CODE = "CASE WHEN o_orderkey % 17 = 0 THEN 'missing_idempotency_key' WHEN o_orderkey % 13 = 0 THEN 'validation_error' WHEN o_orderkey % 11 = 0 THEN 'idempotency_conflict' WHEN o_orderkey % 7 = 0 THEN 'in_progress' WHEN o_orderkey % 5 = 0 THEN 'not_found' WHEN o_orderkey % 3 = 0 THEN 'unavailable' WHEN o_orderkey % 19 = 0 THEN 'internal' END"


@query(f"SELECT id, code, CASE code WHEN 'missing_idempotency_key' THEN 400 WHEN 'validation_error' THEN 400 WHEN 'idempotency_conflict' THEN 409 WHEN 'in_progress' THEN 409 WHEN 'not_found' THEN 404 WHEN 'unavailable' THEN 503 WHEN 'internal' THEN 500 ELSE 202 END AS status FROM (SELECT o_orderkey AS id, {_CODE} AS code FROM orders)")
def error_codes(spark, d):
    k = F.col("o_orderkey")
    outcome = F.when(k % 11 == 0, "conflict").when(k % 7 == 0, "in_progress").when(k % 19 == 0, None).otherwise("reserved")
    code = requests.error_code(F.when(k % 17 == 0, "").otherwise("k"), F.when(k % 13 == 0, "missing_field"), outcome, k % 5 != 0, k % 3 != 0)
    return D.table(spark, d, "orders").select(k.alias("id"), code.alias("code"), requests.http_status(code).alias("status"))


_OUTCOMES = f"""(SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'reserved' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM {S.EVENTS} WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))"""


@query(f"SELECT event_id, outcome FROM {_OUTCOMES}")
def idempotency_outcomes(spark, d):
    return requests.outcomes(D.events(spark, d)).select("event_id", "outcome")


@query(f"SELECT key, event_id FROM {S.EVENTS} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1")
def reserved_keys(spark, d):
    return requests.first_wins(D.events(spark, d)).select("key", "event_id")


_STORED = f"""(SELECT key, fingerprint AS f, ['in_progress', 'succeeded', 'failed'][CAST(event_id % 3 + 1 AS INTEGER)] AS s, tus + 30000000 AS e, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS t,
  CASE WHEN event_id % 5 = 0 AND event_id % 15 <> 0 THEN 'T' || event_id END AS own FROM {S.EVENTS} WHERE event_id % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1)"""
_LEASE = f"{S.AS_OF} - 241 * 3600000000"


@query(f"""SELECT event_id, outcome, CASE WHEN outcome = 'replay' THEN CASE WHEN s <> 'in_progress' THEN t ELSE coalesce(t, own) END WHEN outcome = 'in_progress' AND live THEN t END AS transaction_id FROM (
  SELECT event_id, s, t, own, e > {_LEASE} AS live, CASE WHEN s IS NULL THEN 'reserved' WHEN f <> fingerprint THEN 'conflict' WHEN s <> 'in_progress' THEN 'replay' WHEN NOT (e > {_LEASE}) AND coalesce(t, own) IS NOT NULL THEN 'replay' ELSE 'in_progress' END AS outcome
  FROM {S.EVENTS} x LEFT JOIN {_STORED} k ON x.key = k.key)""")
def lease_takeover(spark, d):
    e = D.events(spark, d)
    first = requests.first_wins(e.where("event_id % 4 <> 3"))
    status = F.element_at(F.array(F.lit("in_progress"), F.lit("succeeded"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    keys = first.select("key", F.col("fingerprint").alias("request_fingerprint"), status.alias("status"), F.timestamp_micros(us("ts") + 30_000_000).alias("expires_at"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("transaction_id"))
    own = first.where("event_id % 5 = 0").select(F.col("key").alias("idempotency_key"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("id"), F.create_map(F.when(F.col("event_id") % 15 == 0, "other").otherwise("source"), F.lit("A")).alias("metadata"))
    return requests.lease_outcomes(e, keys, own, D.as_of(spark, d, 1 - 241)).select("event_id", "outcome", "transaction_id")


# ---------------------------------------------------------------- outbox and metrics


@query(f"SELECT id, event_type, attempts FROM {S.OUTBOX} WHERE NOT published AND NOT dead_letter ORDER BY tus, id LIMIT 64")
def outbox_due_topk(spark, d):
    return outbox.due(D.outbox(spark, d), D.as_of(spark, d)).select("id", "event_type", "attempts")


@query(f"SELECT round(coalesce(({S.AS_OF} - min(tus)) / 1000000.0, 0), 6) AS lag_seconds FROM {S.OUTBOX} WHERE NOT published AND NOT dead_letter")
def outbox_lag(spark, d):
    return outbox.lag_seconds(D.outbox(spark, d), D.as_of(spark, d)).select(F.round("lag_seconds", 6).alias("lag_seconds"))


@query(f"SELECT count(*) FILTER (dead_letter) AS n FROM {S.OUTBOX}")
def dead_letters(spark, d):
    return outbox.dead_letters(D.outbox(spark, d))


@query(f"SELECT id, least(300.0, 0.5 * power(2.0, greatest(attempts - 1, 0))) AS wait_seconds, CAST(0 AS DOUBLE) AS wait_unset FROM {S.OUTBOX}")
def backoff_schedule(spark, d):
    return D.outbox(spark, d).select("id", outbox.backoff_seconds(F.col("attempts"), 0.5).alias("wait_seconds"), outbox.backoff_seconds(F.col("attempts"), 0).alias("wait_unset"))


@query(f"""SELECT id, published OR (tried AND ok) AS published, CAST(attempts + CASE WHEN tried AND NOT ok THEN 1 ELSE 0 END AS INTEGER) AS attempts, dead_letter OR (tried AND NOT ok AND attempts + 1 >= 8) AS dead_letter,
CASE WHEN tried AND NOT ok AND attempts + 1 < 8 THEN CAST({S.AS_OF} + 500000 * power(2.0, attempts) AS BIGINT) END AS next_us
FROM (SELECT *, NOT published AND NOT dead_letter AS tried, id % 2 = 0 AS ok FROM {S.OUTBOX})""")
def outbox_delivery(spark, d):
    o = D.outbox(spark, d)
    results = outbox.waiting(o).select("id", (F.col("id") % 2 == 0).alias("ok"))
    return outbox.delivered(o, results, D.as_of(spark, d), 0.5).select("id", "published", "attempts", "dead_letter", us("next_attempt_at").alias("next_us"))


@query(f"SELECT tus // 60000000 * 60000000 AS start_us, count(*) AS n, round(count(*) / 60.0, 6) AS per_second FROM {S.EVENTS} GROUP BY 1")
def throughput_1m(spark, d):
    return outbox.rate(D.events(spark, d)).select(us("start").alias("start_us"), "n", F.round("per_second", 6).alias("per_second"))


@query(f"SELECT tus // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second FROM {S.EVENTS} GROUP BY 1, 2")
def outcome_rate(spark, d):
    return outbox.rate(D.events(spark, d), "ts", "1 hour", "event_type").select(us("start").alias("start_us"), "event_type", "n", F.round("per_second", 6).alias("per_second"))


@query(f"SELECT tus // 300000000 * 300000000 AS start_us, count(*) AS n, round(quantile_cont(value, 0.99), 6) AS p99 FROM {S.EVENTS} GROUP BY 1")
def reversal_latency_p99(spark, d):
    return outbox.latency_quantile(D.events(spark, d), value="value").select(us("start").alias("start_us"), "n", F.round("quantile", 6).alias("p99"))


_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0]


@query(" UNION ALL ".join(f"SELECT {b} AS le, count(*) FILTER (value <= {b}) AS n FROM events" for b in _BOUNDS).replace("SELECT 1.0 AS", "SELECT CAST(1.0 AS DOUBLE) AS"))
def latency_histogram(spark, d):
    return outbox.histogram(D.events(spark, d), _BOUNDS, "value").where(~F.isnan("le") & (F.col("le") < 1e300)).select("le", F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- functions and files


@query(f"SELECT o_orderkey AS id, {S.FORMATTED.format('x')} AS formatted FROM (SELECT o_orderkey, {S.AMOUNT.format('o_totalprice')} * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END // CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 1 END AS x FROM orders)")
def money_format(spark, d):
    k = F.col("o_orderkey")
    x = F.expr("cast(round(o_totalprice * 100) as bigint) * case when o_orderkey % 3 = 0 then -1 else 1 end div case when o_orderkey % 5 = 0 then 10000000 else 1 end")
    return D.table(spark, d, "orders").select(k.alias("id"), money.formatted(x).alias("formatted"))


_TOKEN = f"{[*S.TOKENS, '', 'odd']!r}[CAST(o_orderkey % {len(S.TOKENS) + 2} + 1 AS INTEGER)]"


@query(f"SELECT id, status, CASE WHEN status IS NULL THEN '00' ELSE {S.TOKEN_OF.format('status')} END AS token FROM (SELECT o_orderkey AS id, {S.STATUS_OF.format(_TOKEN)} AS status FROM orders)")
def status_tokens(spark, d):
    k = F.col("o_orderkey")
    token = F.element_at(F.array(*[F.lit(t) for t in [*S.TOKENS, "", "odd"]]), (k % (len(S.TOKENS) + 2) + 1).cast("int"))
    status = text.status_of_token(F.concat(F.lit(" \t"), F.lower(token), F.lit(" ")))
    return D.table(spark, d, "orders").select(k.alias("id"), status.alias("status"), text.token_of_status(status).alias("token"))


@query("SELECT o_orderkey AS id, sha256('A|B|' || o_custkey || '|NGN|O-' || o_orderkey) AS fingerprint FROM orders")
def request_fingerprint(spark, d):
    k = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(k.alias("id"), text.request_fingerprint(F.lit("A"), F.lit("B"), F.col("o_custkey"), F.lit("NGN"), F.concat(F.lit("O-"), k.cast("string")), as_json=False).alias("fingerprint"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, true AS has_k, 2 AS merged_size, event_type AS merged_type FROM events")
def metadata_projection(spark, d):
    m = F.from_json("props", "map<string,string>")
    merged = text.merge_metadata(F.map_concat(m, F.create_map(F.lit("type"), F.lit("old"))), F.create_map(F.lit("type"), F.col("event_type")))
    return D.table(spark, d, "events").select(F.col("event_id").alias("id"), F.try_element_at(m, F.lit("k")).alias("k"), F.map_contains_key(m, "k").alias("has_k"), F.size(merged).alias("merged_size"), F.try_element_at(merged, F.lit("type")).alias("merged_type"))


@query(f"SELECT o_orderkey AS id, 'O-' || o_orderkey AS reference, 'A' AS source, 'B' AS destination, {S.AMOUNT.format('o_totalprice')} AS amount_minor, 'NGN' AS currency, 'DEBIT_PENDING' AS state FROM orders WHERE o_orderkey % 2 = 0")
def read_model(spark, d):
    k = F.col("o_orderkey")
    meta = F.when(k % 2 == 0, F.create_map(F.lit("source"), F.lit("A"), F.lit("destination"), F.lit("B"), F.lit("currency"), F.lit("NGN"), F.lit("amount_minor"), money.minor(F.col("o_totalprice")).cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return lifecycle.read_model(D.table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("O-"), k.cast("string")).alias("reference"), F.lit("pending").alias("status"), meta.alias("metadata")))


_FILE_SQL = f"SELECT reference, amount_minor, status, tus AS initiated_us FROM {S.EXTERNAL}"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("reference", "amount_minor", "status", us("initiated_at").alias("initiated_us"))


@query(_FILE_SQL.replace(" tus AS", " tus // 1000000 * 1000000 AS"))
def fixed_csv_round_trip(spark, d):
    path = shared_path(spark, "fixed")
    sinks.write_fixed_csv(D.external_records(spark, d), path)
    return _shown(adapters.read_external(spark, path, "nibss"))


@query(_FILE_SQL.replace(" tus AS", " tus // 1000000 * 1000000 AS"))
def free_csv_round_trip(spark, d):
    path = shared_path(spark, "free")
    rows = D.external_records(spark, d).select(F.lit("x").alias("note"), text.format_rfc3339(F.col("initiated_at")).alias("Initiated_At"), F.col("amount_minor").alias(" AMOUNT_MINOR"), F.col("reference").alias("Reference"))
    rows.write.option("header", True).csv(path)
    return _shown(adapters.read_external(spark, path, "csv"))


@query(f"SELECT reference, type, amount_minor, status, tus AS initiated_us FROM {S.INTERNAL}")
def ledger_json_round_trip(spark, d):
    path = shared_path(spark, "ledger")
    sinks.write_json_lines(D.internal_records(spark, d), path)
    return adapters.read_ledger_json(spark, path).select("reference", "type", "amount_minor", "status", us("initiated_at").alias("initiated_us"))


@query(f"SELECT category, count(*) AS n FROM {S.classified()} WHERE category <> 'matched' GROUP BY category")
def persisted_exceptions(spark, d):
    root = shared_path(spark, "runs")
    rows = classified(spark, d)
    sinks.persist(rows, root, "internal", "external", "print-1")
    sinks.persist(rows, root, "internal", "external", "print-1")  # known: nothing is written
    return sinks.run_exceptions(spark, root).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT code, type FROM (VALUES ('FEES', 'revenue'), ('CUST-001', 'asset'), ('CUST-002', 'asset')) t(code, type)")
def seeded_accounts(spark, d):
    return generate.seed_accounts(spark, D.accounts(spark, d).where("code <> 'FEES'")).select("code", "type")


@query(f"SELECT key, status FROM {S.FOLD}")
def streaming_fold(spark, d):
    from ledgerloom.streaming.machine import fold_stream

    return fold_stream(spark, f"{d}/events.parquet", shared_path(spark, "stream"), D.as_events)


@query(f"SELECT event_type, count(*) AS n FROM {S.OUTBOX} WHERE NOT published AND NOT dead_letter AND id % 2 = 0 GROUP BY event_type")
def streaming_outbox(spark, d):
    from ledgerloom.streaming.delivery import deliver_stream

    out = deliver_stream(spark, f"{d}/events.parquet", shared_path(spark, "outbox"), prepare=D.as_outbox)
    return out.where("published").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT tus // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n FROM {S.EVENTS} GROUP BY 1, 2")
def streaming_rates(spark, d):
    from ledgerloom.streaming.metrics import rate_stream

    return rate_stream(spark, f"{d}/events.parquet", shared_path(spark, "rates"), prepare=D.as_events).select(us("start").alias("start_us"), "event_type", "n")


from ledgerloom.plans import online  # noqa: E402, F401  (more queries, registered in QUERIES)
