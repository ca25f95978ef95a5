"""Tables, enumerations and the transfer state machine's edges."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_TYPES = ("transfer", "reversal", "fee")
RECORD_STATUSES = ("pending", "debited", "settled", "failed", "timed_out", "reversed")
LEDGER_STATUSES = ("pending", "debited", "settled", "failed", "timed_out", "reversed", "in_doubt", "reversal_pending", "manual_review")
ACCOUNT_TYPES = ("asset", "liability", "equity", "revenue", "expense")
DIRECTIONS = ("debit", "credit")
CATEGORIES = ("amount_mismatch", "duplicate", "pending_reversal", "unmatched_external", "unmatched_internal")
RUN_STATUSES = ("running", "completed", "failed")
IDEMPOTENCY_STATUSES = ("in_progress", "succeeded", "failed")

#: Legal edges of a transfer's status; a status without one is terminal.
EDGES = {
    "pending": ("debited", "failed"),
    "debited": ("settled", "in_doubt", "reversal_pending"),
    "in_doubt": ("settled", "reversal_pending", "manual_review"),
    "reversal_pending": ("reversed",),
}
TERMINAL = ("settled", "reversed", "failed", "manual_review")
#: The event that drives a transfer on from a status.
EVENT_FOR_STATUS = {"pending": "debit_requested", "debited": "debited", "in_doubt": "in_doubt", "reversal_pending": "reversal_requested"}
#: Fine states of the machine and the status each is stored as; the representative state of a status is the last one listed with it that is not a synonym.
STATUS_OF_STATE = {
    "INITIATED": "pending",
    "DEBIT_PENDING": "pending",
    "DEBITED": "debited",
    "AWAITING_SETTLEMENT": "debited",
    "IN_DOUBT": "in_doubt",
    "REVERSAL_PENDING": "reversal_pending",
    "SETTLED": "settled",
    "REVERSED": "reversed",
    "MANUAL_REVIEW": "manual_review",
    "FAILED": "failed",
}
STATE_OF_STATUS = {s: "DEBIT_PENDING" if s == "pending" else s.upper() for s in dict.fromkeys(STATUS_OF_STATE.values())}


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_S, _L, _TS, _I, _B = T.StringType(), T.LongType(), T.TimestampType(), T.IntegerType(), T.BooleanType()
_MAP = T.MapType(_S, _S)

#: The canonical record both sides of a reconciliation are read into.
RECORD = _schema(
    ("transaction_id", _S, True), ("reference", _S, True), ("source", _S, True), ("destination", _S, True), ("amount_minor", _L, True), ("currency", _S, True),
    ("type", _S, True), ("status", _S, True), ("initiated_at", _TS, True), ("settled_at", _TS, True), ("metadata", _MAP, True),
)
ACCOUNTS = _schema(("id", _S, False), ("code", _S, False), ("name", _S, True), ("type", _S, False), ("currency", _S, False), ("created_at", _TS, True))
TRANSACTIONS = _schema(
    ("id", _S, False), ("reference", _S, False), ("type", _S, False), ("status", _S, False), ("idempotency_key", _S, True), ("parent_transaction_id", _S, True),
    ("initiated_at", _TS, True), ("settled_at", _TS, True), ("metadata", _MAP, True),
)
ENTRIES = _schema(("id", _S, False), ("transaction_id", _S, False), ("account_id", _S, False), ("direction", _S, False), ("amount_minor", _L, False), ("currency", _S, False), ("created_at", _TS, True))
OUTBOX = _schema(("id", _L, False), ("aggregate_id", _S, False), ("event_type", _S, False), ("payload", _S, True), ("created_at", _TS, False), ("published", _B, False), ("attempts", _I, False), ("next_attempt_at", _TS, True), ("dead_letter", _B, False))
RUNS = _schema(("run_id", _S, False), ("internal_source", _S, True), ("external_source", _S, True), ("status", _S, False), ("matched_count", _L, True), ("exception_count", _L, True), ("summary", _S, True), ("params_hash", _S, True), ("started_at", _TS, True))
EXCEPTIONS = _schema(("run_id", _S, False), ("category", _S, False), ("reference", _S, True), ("internal_record", _S, True), ("external_record", _S, True), ("delta_minor", _L, True))
