"""Requests: validation, idempotency outcomes, leases, error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stable error codes and their HTTP status.
ERROR_CODES = {
    "validation_error": 400,
    "missing_idempotency_key": 400,
    "idempotency_conflict": 409,
    "in_progress": 409,
    "not_found": 404,
    "unavailable": 503,
    "internal": 500,
}


def request_error(source: Column, destination: Column, amount: Column, currency: Column, reference: Column) -> Column:
    """The first thing wrong with a transfer request, in this order; null if nothing is."""
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(absent(source) | absent(destination) | absent(reference), "missing_field")
        .when(F.coalesce(currency, F.lit("")) != "NGN", "unsupported_currency")
        .when(F.coalesce(amount, F.lit(0)) <= 0, "non_positive_amount")
    )


def error_code(key: Column, error: Column, outcome: Column, known: Column, available: Column) -> Column:
    """The code a request is answered with; null for one that is accepted. What cannot be told is internal."""
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "missing_idempotency_key")
        .when(error.isNotNull(), "validation_error")
        .when(outcome == "conflict", "idempotency_conflict")
        .when(outcome == "in_progress", "in_progress")
        .when(~known, "not_found")
        .when(~available, "unavailable")
        .when(outcome.isNull(), "internal")
    )


def http_status(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit(202))
    for name, status in ERROR_CODES.items():
        out = out.when(code == name, status)
    return out.otherwise(500)


def first_wins(requests: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The request that reserves each key."""
    return requests.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def outcomes(requests: DataFrame, key: str = "key", fingerprint: str = "fingerprint", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``requests`` with outcome: the first of a key is reserved; later ones replay it, or conflict with another body."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(fingerprint).over(w)
    kind = F.when(F.row_number().over(w) == 1, "reserved").when(F.col(fingerprint) == first, "replay").otherwise("conflict")
    return requests.withColumn("outcome", kind)


def lease_outcomes(requests: DataFrame, keys: DataFrame, transfers: DataFrame, as_of: Column) -> DataFrame:
    """Requests against stored keys: reserved, conflict, replay, in_progress, with the transfer a replay returns.

    A key in progress replays only when its lease has run out and a transfer is known, from the
    key or, failing that, from the transfer that carries the key (of a table with metadata, only rows with a source are transfers).
    """
    if "metadata" in transfers.columns:
        transfers = transfers.where(F.coalesce(F.map_contains_key("metadata", "source"), F.lit(False)))
    own = transfers.where("idempotency_key is not null").select(F.col("idempotency_key").alias("_tk"), F.col("id").cast("string").alias("_tid"))
    k = keys.select(F.col("key").alias("_k"), F.col("request_fingerprint").alias("_f"), F.col("status").alias("_s"), F.col("expires_at").alias("_e"), F.col("transaction_id").alias("_t"))
    rows = requests.join(k, F.col("key") == F.col("_k"), "left").join(own, F.col("key") == F.col("_tk"), "left")
    known = F.coalesce("_t", "_tid")
    live = F.coalesce(F.col("_e") > as_of, F.lit(False))
    outcome = (
        F.when(F.col("_k").isNull(), "reserved")
        .when(F.col("_f") != F.col("fingerprint"), "conflict")
        .when(F.col("_s").isin("succeeded", "failed"), "replay")
        .when(~live & known.isNotNull(), "replay")
        .otherwise("in_progress")
    )
    rows = rows.withColumn("outcome", outcome)
    shown = F.when(F.col("outcome") == "replay", F.when(F.col("_s").isin("succeeded", "failed"), F.col("_t")).otherwise(known)).when((F.col("outcome") == "in_progress") & live, F.col("_t"))
    return rows.withColumn("transaction_id", shown).withColumn("stored_status", F.when(F.col("outcome") == "replay", F.col("_s"))).drop("_k", "_f", "_s", "_e", "_t", "_tk", "_tid")


def idempotent_creates(requests: DataFrame, error: Column, fails: Column, order: tuple[str, ...] = ("ts", "event_id"), key: str = "key", fingerprint: str = "fingerprint", id: str = "event_id") -> DataFrame:
    """What a log of create requests is answered with: ``requests`` with outcome, key_status, transaction_id, created.

    An invalid request (``error`` not null) is answered with its error and reserves nothing. The first valid one of a
    key reserves it and runs: it creates a transfer under its own id, and the key succeeds, or (``fails``) the key is failed
    without one. Later requests of the key replay its result, or conflict with another body.
    """
    rows = requests.withColumn("_error", error).withColumn("_fails", fails)
    w = Window.partitionBy(key, F.col("_error").isNull()).orderBy(*order)
    first = F.first(F.struct(F.col(fingerprint).alias("f"), F.col("_fails").alias("fails"), F.col(id).cast("string").alias("id"))).over(w)
    rows = rows.withColumn("_first", first).withColumn("_n", F.row_number().over(w))
    kind = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_n") == 1, "reserved").when(F.col(fingerprint) == F.col("_first.f"), "replay").otherwise("conflict")
    rows = rows.withColumn("outcome", kind)
    owns = F.col("outcome").isin("reserved", "replay")
    rows = rows.withColumn("key_status", F.when(owns, F.when(F.col("_first.fails"), "failed").otherwise("succeeded")))
    rows = rows.withColumn("transaction_id", F.when(owns & ~F.col("_first.fails"), F.col("_first.id")))
    return rows.withColumn("created", (F.col("outcome") == "reserved") & ~F.col("_fails")).drop("_error", "_fails", "_first", "_n")


def created_transfers(answers: DataFrame, source: Column, destination: Column, amount: Column, currency: Column, reference: Column, at: Column) -> DataFrame:
    """The transfers that ``idempotent_creates`` inserts: pending, their parties in metadata."""
    meta = F.create_map(F.lit("source"), source, F.lit("destination"), destination, F.lit("amount_minor"), amount.cast("string"), F.lit("currency"), currency)
    return answers.where("created").select(F.col("transaction_id").alias("id"), reference.alias("reference"), F.lit("transfer").alias("type"), F.lit("pending").alias("status"), F.col("key").alias("idempotency_key"), at.alias("initiated_at"), meta.alias("metadata"))


def created_events(transfers: DataFrame) -> DataFrame:
    """The outbox rows written with new transfers: each asks for its debit."""
    return transfers.select(F.col("id").alias("aggregate_id"), F.lit("debit_requested").alias("event_type"), F.to_json("metadata").alias("payload"), F.col("initiated_at").alias("created_at"))


def completed_keys(answers: DataFrame, response: Column) -> DataFrame:
    """(key, status, transaction_id, response) of every reserved key after its request has run; a failed key has no response."""
    done = answers.where("outcome = 'reserved'")
    return done.select("key", F.col("key_status").alias("status"), "transaction_id", F.when(F.col("key_status") == "succeeded", response).alias("response"))
