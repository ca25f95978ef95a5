"""Queries of the online side and of point reads: idempotent creates, the drained outbox, steps of transfers, panels, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import audit, ledger, lifecycle, outbox, requests
from ledgerloom.plans import sql as S
from ledgerloom.plans import tables as D
from ledgerloom.plans.registry import classified, query, shared_path, us
from ledgerloom.sources import adapters, sinks

# ---------------------------------------------------------------- point reads


@query(f"SELECT id, type FROM {S.ACCOUNTS} WHERE id = 'CUST-9'")
def account_by_id(spark, d):
    return D.accounts(spark, d).where("id = 'CUST-9'").select("id", "type")


@query(f"SELECT account_id, balance_minor FROM {S.BALANCES} WHERE account_id = 'SUPP-4'")
def cached_balance(spark, d):
    path = shared_path(spark, "cache")
    ledger.balances(D.accounts(spark, d), D.entries(spark, d)).select("account_id", "balance_minor").write.parquet(path)
    return spark.read.parquet(path).where("account_id = 'SUPP-4'")  # the filter reaches the file's statistics


@query(f"SELECT id, reference, type, status FROM {S.TRANSACTIONS} WHERE id = '7'")
def transaction_by_id(spark, d):
    return D.transactions(spark, d).where("id = '7'").select("id", "reference", "type", "status")


@query(f"SELECT id, status FROM {S.TRANSACTIONS} WHERE idempotency_key = 'K-2'")
def transaction_by_key(spark, d):
    return D.transactions(spark, d).where("idempotency_key = 'K-2'").select("id", "status")


@query(f"SELECT id, reference, status, amount_minor FROM {S.MIDWAY} WHERE id = 7")
def transfer_by_id(spark, d):
    return D.transfers_midway(spark, d).where("id = 7").select("id", "reference", "status", "amount_minor")


@query(f"SELECT id, count(*) AS n FROM (SELECT id FROM {S.ACCOUNTS} UNION ALL SELECT 'CUST-' || c_custkey FROM customer WHERE c_custkey % 50 = 0) GROUP BY id HAVING count(*) > 1")
def duplicate_codes(spark, d):
    again = D.table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("code"))
    return audit.repeated(D.accounts(spark, d).select("code").unionByName(again), "code").select(F.col("code").alias("id"), "n")


@query(f"""SELECT direction, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM {S.entries()} WHERE transaction_id IN (
  SELECT id FROM {S.TRANSACTIONS} WHERE idempotency_key IS NULL OR CAST(substr(idempotency_key, 3) AS BIGINT) % 11 <> 0 QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY CAST(id AS BIGINT)) = 1)
GROUP BY direction""")
def posted_entries(spark, d):
    t = D.transactions(spark, d).withColumn("seq", F.col("id").cast("long"))
    known = D.table(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.concat(F.lit("K-"), F.col("o_orderkey").cast("string")).alias("idempotency_key"))
    _, appended, _ = ledger.post(t, D.entries(spark, d), D.accounts(spark, d), known)
    return appended.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"))


# ---------------------------------------------------------------- idempotent creates

_ANSWERS = f"""(WITH r AS (SELECT *, event_id % 17 = 0 AS bad, event_id % 5 = 0 AS fails FROM {S.EVENTS}),
  w AS (SELECT *, row_number() OVER k AS n, first_value(fingerprint) OVER k AS f, first_value(fails) OVER k AS ff, first_value(event_id) OVER k AS owner FROM r WINDOW k AS (PARTITION BY key, bad ORDER BY ts, event_id)),
  o AS (SELECT *, CASE WHEN bad THEN 'missing_field' WHEN n = 1 THEN 'reserved' WHEN fingerprint = f THEN 'replay' ELSE 'conflict' END AS outcome FROM w)
  SELECT *, CASE WHEN outcome IN ('reserved', 'replay') THEN CASE WHEN ff THEN 'failed' ELSE 'succeeded' END END AS key_status,
    CASE WHEN outcome IN ('reserved', 'replay') AND NOT ff THEN CAST(owner AS VARCHAR) END AS transaction_id FROM o)"""


def _answers(spark, d):
    error = F.when(F.col("event_id") % 17 == 0, "missing_field")
    return requests.idempotent_creates(D.events(spark, d), error, F.col("event_id") % 5 == 0)


@query(f"SELECT event_id, outcome, key_status, transaction_id FROM {_ANSWERS}")
def idempotent_create(spark, d):
    return _answers(spark, d).select("event_id", "outcome", "key_status", "transaction_id")


@query(f"SELECT transaction_id AS id, key AS idempotency_key, 'pending' AS status, event_type AS source, tus AS initiated_us FROM {_ANSWERS} WHERE outcome = 'reserved' AND NOT ff")
def created_transfers(spark, d):
    rows = requests.created_transfers(_answers(spark, d), F.col("event_type"), F.lit("B"), F.col("event_id"), F.lit("NGN"), F.col("key"), F.col("ts"))
    return rows.select("id", "idempotency_key", "status", F.try_element_at("metadata", F.lit("source")).alias("source"), us("initiated_at").alias("initiated_us"))


@query(f"SELECT transaction_id AS aggregate_id, 'debit_requested' AS event_type, event_type AS source, tus AS created_us FROM {_ANSWERS} WHERE outcome = 'reserved' AND NOT ff")
def created_events(spark, d):
    rows = requests.created_transfers(_answers(spark, d), F.col("event_type"), F.lit("B"), F.col("event_id"), F.lit("NGN"), F.col("key"), F.col("ts"))
    return requests.created_events(rows).select("aggregate_id", "event_type", F.get_json_object("payload", "$.source").alias("source"), us("created_at").alias("created_us"))


@query(f"SELECT key, key_status AS status, transaction_id, CASE WHEN NOT ff THEN event_type END AS response FROM {_ANSWERS} WHERE outcome = 'reserved'")
def completed_keys(spark, d):
    return requests.completed_keys(_answers(spark, d), F.col("event_type"))


@query("""SELECT o_orderkey AS id, sha256('{"source":"A\\u0026\\u003c","destination":"B","amount_minor":' || o_custkey || ',"currency":"NGN","reference":"O-' || o_orderkey || '"}') AS fingerprint FROM orders""")
def request_fingerprint_json(spark, d):
    k = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(k.alias("id"), text.request_fingerprint(F.lit("A&<"), F.lit("B"), F.col("o_custkey"), F.lit("NGN"), F.concat(F.lit("O-"), k.cast("string"))).alias("fingerprint"))


# ---------------------------------------------------------------- steps of transfers


@query(f"SELECT id, CASE WHEN status = 'debited' OR status = 'in_doubt' THEN 'settled' ELSE status END AS status, CASE WHEN status = 'debited' OR status = 'in_doubt' THEN tus + 60000000 END AS settled_us FROM {S.MIDWAY}")
def settled_transfers(spark, d):
    at = F.timestamp_micros(us("initiated_at") + 60_000_000)
    return lifecycle.advanced(D.transfers_midway(spark, d), F.lit("settled"), at).select("id", "status", us("settled_at").alias("settled_us"))


_NEXT = "CASE status WHEN 'pending' THEN 'debited' WHEN 'debited' THEN CASE id % 3 WHEN 0 THEN 'in_doubt' WHEN 1 THEN 'reversal_pending' ELSE 'settled' END WHEN 'in_doubt' THEN CASE id % 3 WHEN 0 THEN 'debited' WHEN 1 THEN 'reversal_pending' ELSE 'manual_review' END ELSE 'reversed' END"


@query(f"""SELECT id, s AS status, CASE s WHEN 'debited' THEN 'debited' WHEN 'in_doubt' THEN 'in_doubt' WHEN 'reversal_pending' THEN 'reversal_requested' END AS event FROM (
  SELECT id, t AS s FROM (SELECT id, status AS s, {_NEXT} AS t FROM {S.MIDWAY}) WHERE {S.LEGAL})""")
def follow_up_events(spark, d):
    k, status = F.col("id"), F.col("status")
    either = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    to = F.when(status == "pending", "debited").when(status == "debited", either("in_doubt", "reversal_pending", "settled")).when(status == "in_doubt", either("debited", "reversal_pending", "manual_review")).otherwise("reversed")
    before = D.transfers_midway(spark, d)
    after = lifecycle.advanced(before.withColumn("was", status), to, F.col("initiated_at"))
    return after.where("status <> was").select("id", "status", "event")


@query(f"""SELECT id, event_type, CASE event_type WHEN 'debit_requested' THEN CASE WHEN status <> 'pending' THEN status WHEN id % 5 = 0 THEN 'failed' ELSE 'debited' END
  WHEN 'debited' THEN CASE WHEN status <> 'debited' THEN status ELSE CASE id % 3 WHEN 0 THEN 'settled' WHEN 1 THEN 'reversal_pending' ELSE 'in_doubt' END END
  WHEN 'in_doubt' THEN CASE WHEN status <> 'in_doubt' THEN status ELSE CASE id % 3 WHEN 0 THEN 'settled' WHEN 1 THEN 'reversal_pending' ELSE 'manual_review' END END
  ELSE CASE WHEN status <> 'reversal_pending' THEN status ELSE 'reversed' END END AS status
FROM {S.MIDWAY}, (VALUES ('debit_requested'), ('debited'), ('in_doubt'), ('reversal_requested')) e(event_type)""")
def dispatched_events(spark, d):
    t = D.transfers_midway(spark, d)
    kinds = F.explode(F.array(*[F.lit(e) for e in ("debit_requested", "debited", "in_doubt", "reversal_requested")]))
    events = t.select(F.col("id").cast("string").alias("aggregate_id"), kinds.alias("event_type"))
    verdict = F.when(F.col("id") % 3 == 0, "success").when(F.col("id") % 3 == 1, "declined").otherwise("unknown")
    return lifecycle.dispatched(t, events, F.col("id") % 5 != 0, verdict, verdict)


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'failed' ELSE status END AS status FROM {S.TRANSFERS}")
def unfunded_debits(spark, d):
    return lifecycle.driven(D.transfers(spark, d), F.col("id") % 4 != 0).select("id", "status")


@query(f"""SELECT id, CASE WHEN status <> 'in_doubt' THEN status WHEN id % 3 = 0 THEN 'settled' WHEN id % 3 = 1 THEN 'reversal_pending' ELSE 'manual_review' END AS status FROM {S.MIDWAY}""")
def resolved_by_query(spark, d):
    said = lambda *v: F.array(*[F.lit(x) for x in v])
    verdicts = F.when(F.col("id") % 3 == 0, said("unknown", "success", "declined")).when(F.col("id") % 3 == 1, said("unknown", "unknown", "declined")).otherwise(said("unknown", "unknown", "unknown", "success"))
    return lifecycle.resolved(D.transfers_midway(spark, d), verdicts).select("id", "status")


# ---------------------------------------------------------------- outbox and panels


@query(f"SELECT id, CASE WHEN NOT published AND NOT dead_letter AND row_number() OVER (ORDER BY published OR dead_letter, tus, id) <= 64 THEN {S.AS_OF} + 30000000 END AS next_us FROM {S.OUTBOX}")
def outbox_claim(spark, d):
    return outbox.claimed(D.outbox(spark, d), D.as_of(spark, d)).select("id", us("next_attempt_at").alias("next_us"))


@query("""SELECT id, published OR (NOT dead_letter AND need <= 8) AS published, CAST(CASE WHEN published OR dead_letter THEN attempts WHEN need <= 8 THEN greatest(attempts, need - 1) ELSE 8 END AS INTEGER) AS attempts,
  dead_letter OR (NOT published AND need > 8) AS dead_letter FROM (SELECT *, id % 12 AS need FROM """ + S.OUTBOX + ")")
def outbox_drain(spark, d):
    """Events succeed at attempt number id % 12 or later; those that need more than eight die."""
    handler = lambda rows: rows.select("id", (F.col("attempts") + 1 >= F.col("id") % 12).alias("ok"))
    done = outbox.drained(D.outbox(spark, d), handler, shared_path(spark, "drain"), D.as_of(spark, d), 0.5)
    return done.select("id", "published", "attempts", "dead_letter")


_HOURS = f"(SELECT unnest(range(0, 48)) * 3600000000 + (SELECT min(tus) // 3600000000 * 3600000000 FROM {S.OUTBOX}) AS at_us)"
_LAGS = f"(SELECT at_us, round(greatest((at_us - (SELECT min(tus) FROM {S.OUTBOX} WHERE NOT published AND NOT dead_letter)) / 1000000.0, 0), 6) AS lag_seconds FROM {_HOURS})"


def _lags(spark, d):
    o = D.outbox(spark, d)
    start = F.min((F.floor(us("created_at") / 3_600_000_000) * 3_600_000_000).cast("long"))
    hours = o.agg(start.alias("s")).select("s", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("h")).select(F.timestamp_micros(F.col("s") + F.col("h") * F.lit(3_600_000_000)).alias("at"))
    return outbox.lag_samples(o, hours)


@query(f"SELECT at_us, lag_seconds FROM {_LAGS}")
def outbox_lag_samples(spark, d):
    return _lags(spark, d).select(us("at").alias("at_us"), F.round("lag_seconds", 6).alias("lag_seconds"))


@query(f"SELECT max(lag_seconds) AS max_lag FROM {_LAGS}")
def outbox_lag_max(spark, d):
    return _lags(spark, d).agg(F.max(F.round("lag_seconds", 6)).alias("max_lag"))


@query(f"SELECT tus // 60000000 * 60000000 AS start_us, count(*) AS n, round(count(*) / 60.0, 6) AS per_second FROM {S.EVENTS} WHERE target = 'settled' GROUP BY 1")
def settled_throughput_1m(spark, d):
    return outbox.rate(D.events(spark, d).where("target = 'settled'")).select(us("start").alias("start_us"), "n", F.round("per_second", 6).alias("per_second"))


_RETRIES = "CASE WHEN event_id % 40 = 0 THEN 'exhausted' WHEN event_id % 4 = 0 THEN 'retry' END"


@query(f"SELECT tus // 60000000 * 60000000 AS start_us, {_RETRIES} AS kind, count(*) AS n, round(count(*) / 60.0, 6) AS per_second FROM {S.EVENTS} WHERE event_id % 4 = 0 GROUP BY 1, 2")
def retry_rates(spark, d):
    kind = F.when(F.col("event_id") % 40 == 0, "exhausted").when(F.col("event_id") % 4 == 0, "retry")
    rows = D.events(spark, d).withColumn("kind", kind).where("kind is not null")
    return outbox.rate(rows, "ts", "1 minute", "kind").select(us("start").alias("start_us"), "kind", "n", F.round("per_second", 6).alias("per_second"))


@query(f"SELECT count(*) AS n FROM {S.EVENTS} WHERE event_id % 40 = 0")
def retries_exhausted(spark, d):
    return D.events(spark, d).agg(F.count_if(F.col("event_id") % 40 == 0).alias("n"))


@query("SELECT CASE WHEN b = 'inf' THEN CAST('inf' AS DOUBLE) ELSE CAST(b AS DOUBLE) END IS NOT NULL AND b = 'inf' AS last, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'inf' AS b, count(*) AS n FROM events UNION ALL SELECT '10', count(*) FILTER (value <= 10) FROM events) GROUP BY 1")
def latency_buckets(spark, d):
    """The histogram with its last, unbounded bucket, which holds every row."""
    rows = outbox.histogram(D.events(spark, d), [10.0], "value")
    return rows.select((F.col("le") == float("inf")).alias("last"), F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- sinks and runs


@query(f"""SELECT id AS transaction_id, reference, type, status, tus AS initiated_us FROM {S.TRANSACTIONS} WHERE tus >= epoch_us(TIMESTAMP '1995-01-01') AND tus < epoch_us(TIMESTAMP '1996-01-01')""")
def export_file_round_trip(spark, d):
    path = shared_path(spark, "export")
    rows = ledger.export(D.transactions(spark, d), D.entries(spark, d), D.accounts(spark, d), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))
    sinks.write_export(rows, path)
    read = spark.read.schema(rows.schema).json(path)
    return read.select("transaction_id", "reference", "type", "status", us("initiated_at").alias("initiated_us"))


@query(f"""SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'Reconciliation report' AS line UNION ALL SELECT '  internal:   in' UNION ALL SELECT '  external:   ex' UNION ALL SELECT '  by category:' UNION ALL SELECT 'exceptions:'
  UNION ALL SELECT '  matched:    ' || count(*) FILTER (category = 'matched') FROM {S.classified()} UNION ALL SELECT '  exceptions: ' || count(*) FILTER (category <> 'matched') FROM {S.classified()}
  UNION ALL SELECT '    ' || rpad(category, 20, ' ') || ' ' || count(*) FROM {S.classified()} WHERE category <> 'matched' GROUP BY category
  UNION ALL SELECT '  [' || category || ']' FROM {S.classified()} WHERE category <> 'matched') GROUP BY line""")
def report_folder(spark, d):
    path = shared_path(spark, "report")
    sinks.write_text_report(classified(spark, d), path, "in", "ex")
    line = F.when(F.col("value").startswith("  ["), F.regexp_extract("value", r"^  \[[a-z_]+\]", 0)).otherwise(F.col("value"))
    return spark.read.text(path).groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS fingerprint, arg_max(run_id, row(o_orderdate, run_id)) AS run_id FROM (SELECT *, sha256(CAST(o_orderkey AS VARCHAR)) AS run_id FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_custkey")
def newest_runs(spark, d):
    rows = D.table(spark, d, "orders").select(
        F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("run_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.to_json(F.struct(F.col("o_custkey").cast("string").alias("input_fingerprint"))).alias("summary"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )
    return sinks.newest_completed(rows)


@query(f"SELECT reference, internal_minor AS amount_minor FROM {S.classified()} WHERE category = 'pending_reversal'")
def feedback_once(spark, d):
    """A run that is repeated appends its requests once."""
    from ledgerloom.operators import reconcile

    path, asked = shared_path(spark, "feedback"), reconcile.corrective_requests(classified(spark, d))
    for _ in range(2):
        sinks.append_requests(asked, path, "print-1")
    return spark.read.parquet(path).select("reference", "amount_minor")


@query(f"SELECT category, count(*) FILTER (internal_minor IS NOT NULL) AS internal, count(*) FILTER (external_minor IS NOT NULL) AS external, CAST(coalesce(sum(coalesce(internal_minor, 0) + coalesce(external_minor, 0)), 0) AS BIGINT) AS amounts FROM {S.classified()} WHERE category <> 'matched' GROUP BY category")
def persisted_records(spark, d):
    """The JSON columns of kept exceptions, read back."""
    root = shared_path(spark, "kept")
    sinks.persist(classified(spark, d), root, "internal", "external", "print-2")
    minor = lambda side: F.get_json_object(f"{side}_record", "$.amount_minor").cast("long")
    rows = sinks.run_exceptions(spark, root).select("category", minor("internal").alias("i"), minor("external").alias("e"))
    return rows.groupBy("category").agg(F.count("i").alias("internal"), F.count("e").alias("external"), F.sum(F.coalesce("i", F.lit(0)) + F.coalesce("e", F.lit(0))).alias("amounts"))


@query("SELECT count(*) AS n, true AS same FROM orders")
def folder_fingerprint(spark, d):
    """A folder of files has a fingerprint of its bytes: the same when read again."""
    path = shared_path(spark, "many")
    D.table(spark, d, "orders").select("o_orderkey").repartition(4, "o_orderkey").write.json(path)
    same = adapters.fingerprint(spark, path) == adapters.fingerprint(spark, path)
    return spark.read.json(path).agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.lit(same))


@query(f"SELECT category, count(*) AS n, CAST(coalesce(sum(delta_minor), 0) AS BIGINT) AS delta_minor FROM {S.classified()} GROUP BY category")
def streaming_match(spark, d):
    """The external side as a stream of files, matched batch by batch, then closed: the same summary as in one run."""
    from ledgerloom.operators import reconcile
    from ledgerloom.streaming.matching import match_stream

    source = shared_path(spark, "external")
    D.external_records(spark, d).repartitionByRange(3, "seq").write.parquet(source)
    return reconcile.summary(match_stream(spark, D.internal_records(spark, d), source, shared_path(spark, "matching"), files_per_batch=1))
