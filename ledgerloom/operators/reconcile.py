"""Reconciliation: match an internal ledger with an external file by reference, and classify the rest.

Both sides are canonical records with ``seq``, the order of their rows (a DataFrame has none of its
own). Per reference the internal side keeps its last row that is no reversal, the external side its
first; both are reduced before the one full outer join, so a match is one row. Repeats of an external
reference are duplicates and come from the same window, without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.spread import partitions

SIDE = ("transaction_id", "reference", "source", "destination", "amount_minor", "currency", "type", "status", "initiated_at", "settled_at", "metadata", "seq")


def within(a: Column, b: Column, window_seconds: float) -> Column:
    """|a - b| <= window, inclusive; holds when the window is not positive or a time is missing."""
    if window_seconds <= 0:
        return F.lit(True)
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= F.lit(round(window_seconds * 1_000_000)), F.lit(True))


def settled_reversals(internal: DataFrame) -> DataFrame:
    """References with a settled reversal."""
    return internal.where("type = 'reversal' and status = 'settled'").select("reference").distinct()


def internal_index(internal: DataFrame) -> DataFrame:
    """The last row of each reference that is no reversal, and whether the reference has a settled reversal.

    One exchange by reference, which the outer join then finds in place. (References hardly repeat, so
    a partial aggregate would sort every row twice for nothing.)
    """
    kept = F.col("type") != "reversal"
    one = Window.partitionBy("reference")
    ranked = internal.withColumns(
        {
            "_n": F.row_number().over(one.orderBy(F.when(kept, 0).otherwise(1), F.desc("seq"))),
            "has_settled_reversal": F.max((F.col("type") == "reversal") & (F.col("status") == "settled")).over(one),
        }
    )
    row = F.struct(*[F.col(c) for c in internal.columns])
    return ranked.where(kept & (F.col("_n") == 1)).select("reference", row.alias("i"), F.coalesce("has_settled_reversal", F.lit(False)).alias("has_settled_reversal"))


def external_ranked(external: DataFrame) -> DataFrame:
    """External rows with ``n``, their occurrence within the reference in the file's order."""
    return external.withColumn("n", F.row_number().over(Window.partitionBy("reference").orderBy("seq")))


def blank_index(internal: DataFrame) -> DataFrame:
    """``internal_index`` of rows with blank references: at most two rows, without a window."""
    kept, row = F.col("type") != "reversal", F.struct(*[F.col(c) for c in internal.columns])
    settled = F.max((F.col("type") == "reversal") & (F.col("status") == "settled"))
    by = internal.groupBy("reference").agg(F.max_by(F.when(kept, row), F.when(kept, F.col("seq"))).alias("i"), F.coalesce(settled, F.lit(False)).alias("has_settled_reversal"))
    return by.where("i is not null").select("reference", "i", "has_settled_reversal")


def blank_ranked(external: DataFrame) -> DataFrame:
    """External rows with blank references and ``n``: 1 for the first in the file's order, 2 for any other."""
    first = external.groupBy(F.col("reference").alias("_r")).agg(F.min("seq").alias("_first"))  # at most two rows
    rows = external.join(F.broadcast(first), F.col("reference").eqNullSafe(F.col("_r")))
    return rows.withColumn("n", F.when(F.col("seq") == F.col("_first"), 1).otherwise(2)).drop("_r", "_first")


def classify(internal: DataFrame, external: DataFrame, window_seconds: float = 120) -> DataFrame:
    """One row per outcome: category (``matched`` or an exception's), reference, internal, external, delta_minor, reason.

    Repeats of an external reference join the index at no cost of their own: they stay on their side of
    a union after the window, and only first occurrences go into the outer join. A null reference matches nothing.
    Both sides are dealt out by reference in partitions of a fixed share of the input, which the windows and the join sort.
    """
    blank = F.coalesce(F.col("reference"), F.lit("")) == ""
    n = partitions(internal, external)
    dealt = lambda rows: rows.where(~blank).repartition(n, "reference")
    named = outcomes(internal_index(dealt(internal)), external_ranked(dealt(external)), external.columns, window_seconds)
    return named.unionByName(outcomes(blank_index(internal.where(blank)), blank_ranked(external.where(blank)), external.columns, window_seconds))


def outcomes(index: DataFrame, ranked: DataFrame, columns: list[str], window_seconds: float) -> DataFrame:
    """The outcomes of an internal index and external rows (``columns``) with their occurrence ``n``."""
    e = F.struct(*[F.col(c) for c in columns])
    first = ranked.where("n = 1").select(F.col("reference").alias("e_reference"), e.alias("e"))
    index = index.withColumnRenamed("reference", "i_reference")
    joined = index.join(first, F.col("i_reference") == F.col("e_reference"), "full_outer")
    missing_in, missing_ex = F.col("i").isNull(), F.col("e").isNull()
    same_currency = F.col("i.currency") == F.col("e.currency")
    same_amount = F.col("i.amount_minor") == F.col("e.amount_minor")
    close = within(F.col("i.initiated_at"), F.col("e.initiated_at"), window_seconds)
    owed = (F.col("i.type") == "transfer") & F.col("i.status").isin("failed", "timed_out") & ~F.col("has_settled_reversal")
    category = (
        F.when(missing_in, "unmatched_external")
        .when(missing_ex & owed, "pending_reversal")
        .when(missing_ex, "unmatched_internal")
        .when(F.coalesce(same_currency & same_amount & close, F.lit(False)), "matched")
        .otherwise("amount_mismatch")
    )
    reason = F.when(category != "amount_mismatch", None).when(~same_currency, "currency").when(~same_amount, "amount").otherwise("window")
    delta = F.when(category == "amount_mismatch", F.col("e.amount_minor") - F.col("i.amount_minor"))
    out = joined.select(
        category.alias("category"),
        F.coalesce("i_reference", "e_reference").alias("reference"),
        F.col("i").alias("internal"),
        F.col("e").alias("external"),
        delta.alias("delta_minor"),
        reason.alias("reason"),
        F.coalesce(F.col("e.seq"), F.col("i.seq")).alias("order_seq"),
    )
    return out.unionByName(repeats(ranked.where("n > 1").select(*columns), out))


def repeats(external: DataFrame, like: DataFrame) -> DataFrame:
    """External rows as duplicates, in the columns of the outcomes ``like``."""
    return external.select(
        F.lit("duplicate").alias("category"), "reference", F.lit(None).cast(like.schema["internal"].dataType).alias("internal"), F.struct(*[F.col(c) for c in external.columns]).alias("external"),
        F.lit(None).cast("long").alias("delta_minor"), F.lit(None).cast("string").alias("reason"), F.col("seq").alias("order_seq"),
    )


def exceptions(classified: DataFrame) -> DataFrame:
    return classified.where("category <> 'matched'")


def in_report_order(rows: DataFrame) -> DataFrame:
    """By category, reference and delta (missing counts 0), then by the rows' order."""
    return rows.orderBy("category", "reference", F.coalesce("delta_minor", F.lit(0)), "order_seq")


def summary(classified: DataFrame) -> DataFrame:
    """(category, n, delta_minor): a partial aggregate over the classified rows."""
    return classified.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("delta_minor"), F.lit(0)).alias("delta_minor"))


def counts(classified: DataFrame) -> DataFrame:
    """(matched_count, exception_count) in one row."""
    return classified.agg(F.count_if(F.col("category") == "matched").alias("matched_count"), F.count_if(F.col("category") != "matched").alias("exception_count"))


def summary_json(classified: DataFrame, fingerprint: str) -> DataFrame:
    """One row: the run's summary as JSON, categories in order."""
    by = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    parts = by.agg(
        F.coalesce(F.sum(F.when(F.col("category") == "matched", F.col("n"))), F.lit(0)).alias("matched"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("category") != "matched", F.struct("category", "n"))))).alias("by_category"),
    )  # at most six categories are gathered
    return parts.select(F.to_json(F.struct(F.lit(fingerprint).alias("input_fingerprint"), "matched", "by_category")).alias("summary"))


def internal_duplicates(internal: DataFrame) -> DataFrame:
    """Audit: references with more than one internal row that is no reversal (the last one counts)."""
    return internal.where("type <> 'reversal'").groupBy("reference").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def status_conflicts(classified: DataFrame) -> DataFrame:
    """Audit: matches whose two sides disagree on the status, which the match does not look at."""
    return classified.where("category = 'matched' and internal.status <> external.status").select("reference", F.col("internal.status").alias("internal_status"), F.col("external.status").alias("external_status"))


def corrective_requests(classified: DataFrame) -> DataFrame:
    """What the feedback step asks for: one reversal request for each pending reversal."""
    return classified.where("category = 'pending_reversal'").select("reference", F.col("internal.amount_minor").alias("amount_minor"), F.col("internal.currency").alias("currency"), F.lit("reverse").alias("action"))


def feedback_tally(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(sent, failed): requests whose reference has a transfer, and those that have none (they do not stop the rest)."""
    hit = requests.join(known.select(F.col("reference").alias("_r")).distinct(), F.col("reference") == F.col("_r"), "left")
    return hit.agg(F.count_if(F.col("_r").isNotNull()).alias("sent"), F.count_if(F.col("_r").isNull()).alias("failed"))
