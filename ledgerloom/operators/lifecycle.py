"""Transfers: a guarded state machine as a fold over events, the rail's decisions, and the legs they post.

The machine is declared once (``schemas.EDGES``); the fold, the audits and the stream all use it. A
batch folds each key's sorted events with built-in functions; an illegal step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rail import Chaos, query_verdict, send_verdict, terminal
from ledgerloom.functions.text import leg_key
from ledgerloom.schemas import EDGES, EVENT_FOR_STATUS, STATE_OF_STATUS, STATUS_OF_STATE, TERMINAL
from ledgerloom.ship import ship

SETTLEMENT = "SETTLEMENT"


def legal(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for start, ends in EDGES.items():
        out = out | ((a == start) & b.isin(*ends))
    return out


def is_terminal(status: Column) -> Column:
    return ~status.isin(*EDGES)


def status_of_state(state: Column) -> Column:
    out = F.when(state.isNull(), F.lit(None).cast("string"))
    for name, status in STATUS_OF_STATE.items():
        out = out.when(state == name, status)
    return out.otherwise("pending")


def state_of_status(status: Column) -> Column:
    out = F.when(status.isNull(), F.lit(None).cast("string"))
    for name, state in STATE_OF_STATUS.items():
        out = out.when(status == name, state)
    return out.otherwise("DEBIT_PENDING")


def folded(targets: Column, start: str = "pending") -> Column:
    """The state after an array of targets in order; steps without a legal edge are skipped."""
    return F.aggregate(targets, F.lit(start), lambda s, t: F.when(legal(s, t), t).otherwise(s))


def fold_events(events: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "event_id"), target: str = "target", start: str = "pending") -> DataFrame:
    """(key, status, n_events) of every key. A key's events are gathered for the fold: its history is bounded by the machine's users, not by the table."""
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, target))).alias("_events"))
    return rows.select(key, folded(F.transform("_events", lambda e: e[target]), start).alias("status"), F.size("_events").cast("long").alias("n_events"))


def rail_outcomes(transfers: DataFrame, chaos: Chaos, reference: str = "reference") -> DataFrame:
    """``transfers`` with the rail's faults, the verdicts of sending and asking, and the terminal status. No shuffle."""
    ship(transfers.sparkSession)
    rows = transfers.withColumn("_drawn", chaos.drawn(F.col(reference)))
    rows = rows.withColumns(chaos.sends(F.col("_drawn"))).drop("_drawn")
    return rows.withColumns(
        {
            "send_verdict": send_verdict(F.col("send_timeout"), F.col("declined")),
            "query_verdict": query_verdict(F.col("tsq_timeout"), F.col("declined")),
            "terminal": terminal(F.col("send_timeout"), F.col("declined"), F.col("tsq_timeout")),
            "callbacks": F.when(~F.col("send_timeout") & ~F.col("declined") & F.col("duplicate"), 2).otherwise(0),
        }
    )


def driven(transfers: DataFrame, funded: Column | None = None) -> DataFrame:
    """The events each transfer goes through, folded: debit, send, query, reversal, as the verdicts say.

    ``transfers`` is the result of ``rail_outcomes``; ``funded`` false makes the debit fail for good.
    """
    ok = F.lit(True) if funded is None else funded
    send, ask = F.col("send_verdict"), F.col("query_verdict")
    of = lambda v: F.when(v == "success", "settled").when(v == "declined", "reversal_pending")
    steps = F.array(
        F.when(ok, "debited").otherwise("failed"),
        F.coalesce(of(send), F.lit("in_doubt")),
        F.coalesce(of(ask), F.lit("manual_review")),
        F.lit("reversed"),
    )
    return transfers.withColumn("status", folded(steps)).withColumn("state", state_of_status(F.col("status")))


def queried(verdicts: Column, attempts: int = 3) -> Column:
    """The verdict of asking the rail at most ``attempts`` times: the first that decides; unknown if none does."""
    asked = F.filter(F.slice(verdicts, 1, attempts), lambda v: v.isin("success", "declined"))
    return F.coalesce(F.get(asked, F.lit(0)), F.lit("unknown"))


def resolved(transfers: DataFrame, verdicts: Column, attempts: int = 3) -> DataFrame:
    """Transfers in doubt after asking: settled, waiting for their reversal, or held for a person. Others are as they were."""
    verdict = queried(verdicts, attempts)
    target = F.when(verdict == "success", "settled").when(verdict == "declined", "reversal_pending").otherwise("manual_review")
    return transfers.withColumn("status", F.when(F.col("status") == "in_doubt", target).otherwise(F.col("status")))


def advanced(transfers: DataFrame, to: Column, at: Column) -> DataFrame:
    """``transfers`` with status, settled_at and event after a step: a step without a legal edge changes nothing.

    A settled transfer gets its settled_at; a step to a status that has more to do emits its event for the outbox.
    """
    rows = transfers.withColumn("_to", to).withColumn("_moves", F.coalesce(legal(F.col("status"), F.col("_to")), F.lit(False)))
    before = F.col("settled_at") if "settled_at" in transfers.columns else F.lit(None).cast("timestamp")
    rows = rows.withColumn("settled_at", F.when(F.col("_moves") & (F.col("_to") == "settled"), at).otherwise(before))
    rows = rows.withColumn("event", F.when(F.col("_moves"), event_for_status(F.col("_to"))))
    return rows.withColumn("status", F.when(F.col("_moves"), F.col("_to")).otherwise(F.col("status"))).drop("_to", "_moves")


def dispatched(transfers: DataFrame, events: DataFrame, funded: Column, send: Column, ask: Column) -> DataFrame:
    """(id, event_type, status): what each event (aggregate_id, event_type) does to its transfer.

    A handler acts only from the status its event is for, so a late or repeated event changes nothing; an event that no
    handler knows raises.
    """
    rows = events.join(transfers, F.col("aggregate_id") == F.col("id").cast("string"))
    of = lambda v: F.when(v == "success", "settled").when(v == "declined", "reversal_pending")
    steps = {
        "debit_requested": F.when(funded, "debited").otherwise("failed"),
        "debited": F.coalesce(of(send), F.lit("in_doubt")),
        "in_doubt": F.coalesce(of(ask), F.lit("manual_review")),
        "reversal_requested": F.lit("reversed"),
    }
    status = F.when(F.col("event_type").isNull(), F.col("status"))
    for wanted, event in EVENT_FOR_STATUS.items():
        status = status.when(F.col("event_type") == event, F.when(F.col("status") == wanted, steps[event]).otherwise(F.col("status")))
    failed = F.raise_error(F.concat(F.lit("no handler for event "), F.col("event_type"))).cast("string")
    return rows.select("id", "event_type", status.otherwise(failed).alias("status"))


def callback_target(verdict: Column) -> Column:
    """The step a rail's callback asks for; none for a callback that decides nothing."""
    return F.when(verdict == "success", "settled").when(verdict == "declined", "reversal_pending")


def apply_callbacks(transfers: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Transfers after their callbacks, by reference: repeats are no-ops, and so are illegal steps."""
    asked = callbacks.withColumn("_target", callback_target(F.col("verdict"))).where("_target is not null")
    steps = asked.groupBy("reference").agg(F.sort_array(F.collect_list(F.struct("seq", "_target"))).alias("_steps"))
    joined = transfers.join(steps, "reference", "left")
    targets = F.coalesce(F.transform("_steps", lambda s: s["_target"]), F.array().cast("array<string>"))
    after = F.aggregate(targets, F.col("status"), lambda s, t: F.when(legal(s, t), t).otherwise(s))
    return joined.withColumn("status", after).drop("_steps")


def legs(transfers: DataFrame) -> DataFrame:
    """The ledger transactions of finished transfers: a debit each, then a settlement or a reversal.

    A narrow projection and an explode; a reversal's parent is its transfer's debit leg.
    """
    tid = F.col("id").cast("string")

    def leg(name: str, kind: str, debit: Column, credit: Column, parent: Column, when: Column) -> Column:
        parts = F.struct(leg_key(tid, name).alias("id"), leg_key(tid, name).alias("idempotency_key"), F.lit(kind).alias("type"), debit.alias("debit_account"), credit.alias("credit_account"), parent.alias("parent_transaction_id"))
        return F.when(when, parts)

    none, hold = F.lit(None).cast("string"), F.lit(SETTLEMENT)
    each = F.array(
        leg("debit", "transfer", F.col("source"), hold, none, F.col("status").isin("settled", "reversed", "manual_review")),
        leg("settle", "transfer", hold, F.col("destination"), none, F.col("status") == "settled"),
        leg("reversal", "reversal", hold, F.col("source"), leg_key(tid, "debit"), F.col("status") == "reversed"),
    )
    rows = transfers.select(F.col("id").alias("transfer_id"), "reference", "amount_minor", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("leg"))
    return rows.select("transfer_id", "reference", "amount_minor", "leg.*")


def leg_entries(rows: DataFrame) -> DataFrame:
    """Two entries for each leg: (id, transaction_id, account_id, direction, amount_minor, currency)."""
    each = F.explode(F.array(F.struct(F.lit("debit").alias("direction"), F.col("debit_account").alias("account_id")), F.struct(F.lit("credit").alias("direction"), F.col("credit_account").alias("account_id"))))
    out = rows.select(F.col("id").alias("transaction_id"), "amount_minor", each.alias("e"))
    return out.select(F.concat_ws(":", "transaction_id", "e.direction").alias("id"), "transaction_id", "e.account_id", "e.direction", "amount_minor", F.lit("NGN").alias("currency"))


def stuck(transfers: DataFrame, outbox: DataFrame) -> DataFrame:
    """Transfers on their way that no live event drives (an anti join); oldest first."""
    live = outbox.where("not published and not dead_letter").select(F.col("aggregate_id").alias("_id")).distinct()
    open_ = transfers.where(~F.col("status").isin(*TERMINAL))
    return open_.join(live, F.col("id").cast("string") == F.col("_id"), "left_anti").orderBy("initiated_at", "id")


def resumable(transfers: DataFrame) -> DataFrame:
    return transfers.where(F.col("status").isin(*EDGES)).orderBy("initiated_at", "id")


def event_for_status(status: Column) -> Column:
    out = F.when(status.isNull(), F.lit(None).cast("string"))
    for name, event in EVENT_FOR_STATUS.items():
        out = out.when(status == name, event)
    return out


def recovery_events(rows: DataFrame) -> DataFrame:
    """(aggregate_id, event_type) that sets each stuck transfer going again."""
    return rows.select(F.col("id").cast("string").alias("aggregate_id"), event_for_status(F.col("status")).alias("event_type")).where("event_type is not null")


def requeued_reversals(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """New reversal events for requests whose transfer (the latest of its reference) still waits for its reversal."""
    latest = latest_by_reference(transfers)
    return latest.join(requests.select("reference").distinct(), "reference", "left_semi").where("status = 'reversal_pending'").select(F.col("id").cast("string").alias("aggregate_id"), F.lit("reversal_requested").alias("event_type"))


def latest_by_reference(transfers: DataFrame) -> DataFrame:
    """The newest transfer of each reference, by (initiated_at, id): a partial aggregate, not a window."""
    row = F.struct(*[F.col(c) for c in transfers.columns])
    return transfers.groupBy("reference").agg(F.max_by(row, F.struct("initiated_at", "id")).alias("_row")).select("_row.*")


def outcome_split(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"))


def read_model(transfers: DataFrame) -> DataFrame:
    """The view of transfers whose parties are in metadata."""
    m = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    rows = transfers.where(F.map_contains_key("metadata", "source"))
    return rows.select("id", "reference", m("source").alias("source"), m("destination").alias("destination"), F.try_element_at("metadata", F.lit("amount_minor")).try_cast("long").alias("amount_minor"), m("currency").alias("currency"), state_of_status(F.col("status")).alias("state"))


def last_events(events: DataFrame, key: str = "key") -> DataFrame:
    """Each key's last event, by (ts, event_id)."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
