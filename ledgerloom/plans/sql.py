"""The same results in plain SQL, for DuckDB over the driver's tables. Each constant is a derived table."""

from __future__ import annotations

from ledgerloom.functions.text import STATUS_TOKENS, TOKEN_OF_STATUS
from ledgerloom.schemas import EDGES, TERMINAL

AMOUNT = "CAST(round({} * 100) AS BIGINT)"
_TOTAL = AMOUNT.format("o_totalprice")

INTERNAL = f"""(SELECT 'O-' || CASE WHEN o_orderkey % 20 = 19 THEN o_orderkey - 1 ELSE o_orderkey END AS reference,
  CASE WHEN o_orderkey % 20 = 19 THEN 'reversal' ELSE 'transfer' END AS type,
  CASE WHEN o_orderkey % 20 = 19 OR o_orderstatus = 'F' THEN 'settled' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'timed_out' END AS status,
  {_TOTAL} AS amount_minor, 'NGN' AS currency, epoch_us(o_orderdate) AS tus, o_orderkey AS seq FROM orders)"""

EXTERNAL = f"""(SELECT 'O-' || o_orderkey AS reference, {_TOTAL} + CASE WHEN o_orderkey % 10 = 1 THEN 100 * (o_orderkey % 7 + 1) ELSE 0 END AS amount_minor,
    'NGN' AS currency, 'settled' AS status, epoch_us(o_orderdate) + CASE WHEN o_orderkey % 10 = 3 THEN 600000000 ELSE 30000000 END AS tus, o_orderkey * 10 AS seq
  FROM orders WHERE o_orderkey % 10 NOT IN (8, 9)
  UNION ALL SELECT 'O-' || o_orderkey, {_TOTAL}, 'NGN', 'settled', epoch_us(o_orderdate), o_orderkey * 10 + 1 FROM orders WHERE o_orderkey % 10 = 2
  UNION ALL SELECT 'X-' || o_orderkey, {_TOTAL}, 'NGN', 'settled', epoch_us(o_orderdate), o_orderkey * 10 + 2 FROM orders WHERE o_orderkey % 25 = 0)"""


def classified(window_us: int = 120_000_000) -> str:
    close = "true" if window_us <= 0 else f"coalesce(abs(i.tus - e.tus) <= {window_us}, true)"
    return f"""(WITH internal AS {INTERNAL}, external AS {EXTERNAL},
  i AS (SELECT * FROM internal WHERE type <> 'reversal' QUALIFY row_number() OVER (PARTITION BY reference ORDER BY seq DESC) = 1),
  done AS (SELECT DISTINCT reference FROM internal WHERE type = 'reversal' AND status = 'settled'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY seq) AS n FROM external),
  e AS (SELECT * FROM ranked WHERE n = 1),
  pairs AS (SELECT coalesce(i.reference, e.reference) AS reference,
      CASE WHEN i.reference IS NULL THEN 'unmatched_external'
           WHEN e.reference IS NULL AND i.type = 'transfer' AND i.status IN ('failed', 'timed_out') AND done.reference IS NULL THEN 'pending_reversal'
           WHEN e.reference IS NULL THEN 'unmatched_internal'
           WHEN i.currency = e.currency AND i.amount_minor = e.amount_minor AND {close} THEN 'matched' ELSE 'amount_mismatch' END AS category,
      CASE WHEN i.currency <> e.currency THEN 'currency' WHEN i.amount_minor <> e.amount_minor THEN 'amount' ELSE 'window' END AS why,
      i.amount_minor AS internal_minor, e.amount_minor AS external_minor, i.status AS internal_status, e.status AS external_status
    FROM i FULL JOIN e ON i.reference = e.reference LEFT JOIN done ON i.reference = done.reference)
  SELECT reference, category, CASE WHEN category = 'amount_mismatch' THEN external_minor - internal_minor END AS delta_minor,
    CASE WHEN category = 'amount_mismatch' THEN why END AS reason, internal_minor, external_minor, internal_status, external_status FROM pairs
  UNION ALL SELECT reference, 'duplicate', NULL, NULL, NULL, amount_minor, NULL, status FROM ranked WHERE n > 1)"""


ACCOUNTS = """(SELECT 'CUST-' || c_custkey AS id, 'asset' AS type FROM customer UNION ALL SELECT 'SUPP-' || s_suppkey, 'liability' FROM supplier
  UNION ALL SELECT 'BEN-' || i, 'asset' FROM range(1, 6) r(i) UNION ALL SELECT 'SETTLEMENT', 'liability' UNION ALL SELECT 'FEES', 'revenue')"""


def entries(broken: bool = False) -> str:
    amount = AMOUNT.format("l_extendedprice")
    zero = "l_orderkey % 445 = 0" if broken else "false"
    own = f"CASE WHEN l_orderkey % 79 = 0 THEN 0 ELSE {amount} END" if broken else amount
    extra, currency, direction = ("CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END", "CASE WHEN l_orderkey % 89 = 0 THEN 'USD' ELSE 'NGN' END", "CASE WHEN l_orderkey % 83 = 0 THEN 'sideways' ELSE 'credit' END") if broken else ("0", "'NGN'", "'credit'")
    key = f"l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || {AMOUNT.format('l_quantity')} || '-' || {amount}"
    return f"""(SELECT {key} || '-debit' AS id, CAST(l_orderkey AS VARCHAR) AS transaction_id, 'CUST-' || o_custkey AS account_id, 'debit' AS direction,
    {own} AS amount_minor, 'NGN' AS currency, epoch_us(l_shipdate) AS tus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT {key} || '-' || {direction}, CAST(l_orderkey AS VARCHAR), 'SUPP-' || l_suppkey, {direction}, CASE WHEN {zero} THEN 0 ELSE {amount} + {extra} END, {currency}, epoch_us(l_shipdate)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


SUMS = f"""(SELECT account_id, CAST(coalesce(sum(amount_minor) FILTER (direction = 'debit'), 0) AS BIGINT) AS debits,
  CAST(coalesce(sum(amount_minor) FILTER (direction = 'credit'), 0) AS BIGINT) AS credits FROM {entries()} GROUP BY account_id)"""
BALANCES = f"""(SELECT a.id AS account_id, a.type, coalesce(debits, 0) AS debits, coalesce(credits, 0) AS credits,
  CASE WHEN a.type IN ('asset', 'expense') THEN coalesce(debits, 0) - coalesce(credits, 0) ELSE coalesce(credits, 0) - coalesce(debits, 0) END AS balance_minor
  FROM {ACCOUNTS} a LEFT JOIN {SUMS} s ON a.id = s.account_id)"""

TRANSACTIONS = """(SELECT CAST(o_orderkey AS VARCHAR) AS id, 'O-' || o_orderkey AS reference,
  CASE WHEN o_orderkey % 77 = 0 THEN 'loan' WHEN o_orderkey % 20 IN (17, 19) THEN 'reversal' ELSE 'transfer' END AS type,
  CASE WHEN o_orderkey % 50 = 0 THEN 'odd' WHEN o_orderstatus = 'F' THEN 'settled' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 30 = 0 THEN NULL WHEN o_orderkey % 45 = 1 THEN 'K-' || (o_orderkey + 1) ELSE 'K-' || o_orderkey END AS idempotency_key,
  CASE WHEN o_orderkey % 500 = 19 THEN 'none' WHEN o_orderkey % 20 = 19 THEN CAST(o_orderkey - 1 AS VARCHAR) WHEN o_orderkey % 20 = 17 THEN CAST(o_orderkey + 1 AS VARCHAR) END AS parent_transaction_id,
  epoch_us(o_orderdate) AS tus, o_orderpriority AS priority FROM orders)"""


def u01(reference: str, dimension: str, seed: int = 42) -> str:
    """The rail's hash by folding unsigned 128-bit integers."""
    before = ", ".join(str(b) for b in seed.to_bytes(8, "little"))
    after = ", ".join(str(b) for b in b"\0" + dimension.encode())
    data = f"list_transform(list_concat([{before}], list_transform(range(1, length({reference}) + 1), lambda i: unicode(substr({reference}, CAST(i AS INTEGER), 1))), [{after}]), lambda x: CAST(x AS UHUGEINT))"
    fold = f"list_reduce({data}, lambda a, x: (xor(a, x) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT), CAST(14695981039346656037 AS UHUGEINT))"
    return f"(CAST({fold} AS DOUBLE) / 18446744073709551616.0)"


TRANSFERS = f"""(WITH t AS (SELECT o_orderkey AS id, 'O-' || o_orderkey AS reference, 'CUST-' || o_custkey AS source, 'BEN-' || substr(o_orderpriority, 1, 1) AS destination,
    {_TOTAL} AS amount_minor, epoch_us(o_orderdate) AS tus FROM orders),
  f AS (SELECT *, {u01("reference", "send_timeout")} < 0.25 AS send_timeout, {u01("reference", "decline")} < 0.30 AS declined, {u01("reference", "duplicate")} < 0.50 AS duplicate,
    {u01("reference", "tsq_timeout")} < 0.30 AS tsq_timeout FROM t)
  SELECT *, CASE WHEN send_timeout AND tsq_timeout THEN 'manual_review' WHEN declined THEN 'reversed' ELSE 'settled' END AS status FROM f)"""

LEGS = f"""(SELECT id AS transfer_id, reference, amount_minor, id || ':debit' AS idempotency_key, 'transfer' AS type, source AS debit_account, 'SETTLEMENT' AS credit_account, NULL AS parent_transaction_id FROM {TRANSFERS}
  UNION ALL SELECT id, reference, amount_minor, id || ':settle', 'transfer', 'SETTLEMENT', destination, NULL FROM {TRANSFERS} WHERE status = 'settled'
  UNION ALL SELECT id, reference, amount_minor, id || ':reversal', 'reversal', 'SETTLEMENT', source, id || ':debit' FROM {TRANSFERS} WHERE status = 'reversed')"""

_MIDWAY = "['pending', 'debited', 'in_doubt', 'reversal_pending', 'settled', 'reversed', 'failed', 'manual_review']"
MIDWAY = f"(SELECT o_orderkey AS id, 'O-' || (o_orderkey - o_orderkey % 3) AS reference, {_MIDWAY}[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS status, {_TOTAL} AS amount_minor, epoch_us(o_orderdate) AS tus FROM orders)"

EVENTS = """(SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS key, ts, epoch_us(ts) AS tus, event_id, event_type, value, props, sha256(event_type) AS fingerprint,
  CASE event_type WHEN 'view' THEN 'debited' WHEN 'click' THEN 'settled' WHEN 'error' THEN 'in_doubt' WHEN 'purchase' THEN 'reversal_pending' WHEN 'signup' THEN 'reversed' END AS target FROM events)"""
LEGAL = " OR ".join(f"(s = '{a}' AND t IN ({', '.join(repr(b) for b in bs)}))" for a, bs in EDGES.items())
FOLD = f"""(SELECT key, count(*) AS n_events, list_reduce(list(target ORDER BY ts, event_id), lambda s, t: CASE WHEN {LEGAL} THEN t ELSE s END, 'pending') AS status FROM {EVENTS} GROUP BY key)"""

OUTBOX = """(SELECT event_id AS id, CAST(user_id AS VARCHAR) AS aggregate_id, event_type, props AS payload, ts, epoch_us(ts) AS tus, event_id % 3 <> 0 AS published, CAST(event_id % 10 AS INTEGER) AS attempts,
  event_id % 3 = 0 AND event_id % 10 >= 8 AS dead_letter FROM events)"""
AS_OF = "(SELECT max(epoch_us(ts)) + 3600000000 FROM events)"

TERMINALS = ", ".join(repr(s) for s in TERMINAL)
FORMATTED = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')"
TOKENS = list(STATUS_TOKENS)
STATUS_OF = "CASE {} " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in STATUS_TOKENS.items()) + " WHEN '' THEN 'settled' END"
TOKEN_OF = "CASE {} " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in TOKEN_OF_STATUS.items()) + " ELSE '00' END"
