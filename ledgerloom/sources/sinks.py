"""Writers: settlement files, JSON lines, reports, and runs with their exceptions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerloom.functions.money import formatted
from ledgerloom.functions.text import format_rfc3339, token_of_status
from ledgerloom.operators.reconcile import exceptions, in_report_order, summary_json
from ledgerloom.schemas import EXCEPTIONS, RUNS
from ledgerloom.sources.adapters import FIXED_COLUMNS


def fixed_layout(records: DataFrame) -> DataFrame:
    """Records as rows of the fixed settlement layout, all text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    columns = [text("reference"), text("source"), text("destination"), F.col("amount_minor").cast("string"), text("currency"), token_of_status(F.col("status")), format_rfc3339(F.col("initiated_at"))]
    return records.select(*[c.alias(n) for c, n in zip(columns, FIXED_COLUMNS, strict=True)])


def write_fixed_csv(records: DataFrame, path: str) -> None:
    fixed_layout(records).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json_lines(records: DataFrame, path: str) -> None:
    records.drop("seq").write.mode("overwrite").option("ignoreNullFields", True).json(path)


def _detail() -> Column:
    """What a report's line adds for its category."""
    one = lambda side: F.concat(F.lit(" amount="), formatted(F.col(f"{side}.amount_minor")), F.lit(" status="), F.col(f"{side}.status"))
    cat = F.col("category")
    mismatch = F.concat(F.lit(" internal="), formatted(F.col("internal.amount_minor")), F.lit(" external="), formatted(F.col("external.amount_minor")), F.format_string(" delta=%+d", F.coalesce("delta_minor", F.lit(0))))
    return F.when(cat == "amount_mismatch", mismatch).when(cat.isin("pending_reversal", "unmatched_internal"), one("internal")).otherwise(one("external"))


def report_lines(classified: DataFrame) -> DataFrame:
    """(category, reference, delta_minor, order_seq, line) of every exception, made by the executors."""
    rows = exceptions(classified)
    return rows.select("category", "reference", "delta_minor", "order_seq", F.concat(F.lit("  ["), "category", F.lit("] ref="), "reference", _detail()).alias("line"))


def _counts(classified: DataFrame) -> tuple[int, dict[str, int]]:
    got = {r["category"]: r["n"] for r in classified.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}  # six categories at most
    return got.pop("matched", 0), dict(sorted(got.items()))


def _head(classified: DataFrame, internal_name: str, external_name: str) -> list[str]:
    """The text report's lines before its exceptions."""
    matched, by = _counts(classified)
    # Fixed text of the report.
    out = ["Reconciliation report", f"  internal:   {internal_name}", f"  external:   {external_name}", f"  matched:    {matched}", f"  exceptions: {sum(by.values())}"]
    return out + (["  by category:", *[f"    {c:<20} {n}" for c, n in by.items()], "exceptions:"] if by else [])


def write_text_report(classified: DataFrame, path: str, internal_name: str, external_name: str) -> None:
    """The text report as a folder of text files, written by executors: in the order of the files' names it is ``text_report``."""
    head = classified.sparkSession.createDataFrame(list(enumerate(_head(classified, internal_name, external_name))), "order_seq long, line string")
    lines = report_lines(classified).select(F.lit(1).alias("part"), "category", "reference", "delta_minor", "order_seq", "line")
    first = head.select(F.lit(0).alias("part"), F.lit("").alias("category"), F.lit("").alias("reference"), F.lit(None).cast("long").alias("delta_minor"), "order_seq", "line")
    every = first.unionByName(lines).orderBy("part", "category", "reference", F.coalesce("delta_minor", F.lit(0)), "order_seq")
    every.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_exceptions_json(classified: DataFrame, path: str) -> None:
    """The exceptions in report order as JSON lines, written by executors; for lists that a driver should not hold."""
    rows = in_report_order(exceptions(classified))
    rows.select("category", "reference", record_json("internal").alias("internal"), record_json("external").alias("external"), "delta_minor", "reason").write.mode("overwrite").json(path)


def write_export(records: DataFrame, path: str) -> None:
    """Exported records in their order as JSON lines."""
    records.orderBy("initiated_at", "transaction_id").write.mode("overwrite").json(path)


def exported(records: DataFrame) -> Iterator[Row]:
    """The same, one record at a time, a partition on the driver at once."""
    yield from records.orderBy("initiated_at", "transaction_id").toLocalIterator()


def append_requests(requests: DataFrame, path: str, fingerprint: str) -> int:
    """Append corrective requests of an input, known by its fingerprint, and return how many are new.

    They move money, so a request of the same input and reference is appended once, however often its run is repeated.
    """
    rows = requests.withColumn("input_fingerprint", F.lit(fingerprint))
    known = _table(requests.sparkSession, path, rows.schema).where(F.col("input_fingerprint") == fingerprint).select("reference")
    fresh = rows.join(known, "reference", "left_anti").select(*rows.columns).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n


def text_report(classified: DataFrame, internal_name: str, external_name: str) -> str:
    """The report for people, as one string (``write_text_report`` writes a large one). It names no time, so the same input gives the same bytes."""
    out = _head(classified, internal_name, external_name)
    out += [r["line"] for r in in_report_order(report_lines(classified)).select("line").toLocalIterator()]
    return "\n".join(out) + "\n"


def record_json(side: str) -> Column:
    """A side's record as JSON, without its place in the file; null for a missing side."""
    fields = ["transaction_id", "reference", "source", "destination", "amount_minor", "currency", "type", "status", "initiated_at", "settled_at", "metadata"]
    row = F.struct(*[(format_rfc3339(F.col(f"{side}.{f}")) if f.endswith("_at") else F.col(f"{side}.{f}")).alias(f) for f in fields])
    return F.when(F.col(side).isNotNull(), F.to_json(row))


def json_report(classified: DataFrame, internal_name: str, external_name: str) -> str:
    """The report for programs: indented by two, keys of by_category sorted, no exceptions as null."""
    matched, by = _counts(classified)
    rows = in_report_order(exceptions(classified)).select("category", "reference", record_json("internal").alias("internal"), record_json("external").alias("external"), "delta_minor")
    listed = []
    for r in rows.toLocalIterator():
        item = {"category": r["category"], "reference": r["reference"]}
        item |= {k: json.loads(r[k]) for k in ("internal", "external") if r[k] is not None}
        if r["delta_minor"] is not None:
            item["delta_minor"] = r["delta_minor"]
        listed.append(item)
    whole = {"internal_source": internal_name, "external_source": external_name, "matched_count": matched, "exception_count": sum(by.values()), "by_category": by, "exceptions": listed or None}
    return json.dumps(whole, indent=2, ensure_ascii=False)


REPORTS = {"text": text_report, "json": json_report}


def render(classified: DataFrame, internal_name: str, external_name: str, format: str = "text") -> str:
    if format not in REPORTS:
        raise ValueError(f"unknown report format {format!r}; known: {', '.join(sorted(REPORTS))}")
    return REPORTS[format](classified, internal_name, external_name)


def exception_rows(classified: DataFrame, run_id: str) -> DataFrame:
    """Rows of the exceptions' table; an empty reference is null."""
    return exceptions(classified).select(F.lit(run_id).alias("run_id"), "category", F.nullif("reference", F.lit("")).alias("reference"), record_json("internal").alias("internal_record"), record_json("external").alias("external_record"), "delta_minor")


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def newest_completed(runs: DataFrame) -> DataFrame:
    """(fingerprint, run_id) of the newest completed run of each input, by (started_at, run_id)."""
    done = runs.where("status = 'completed'").withColumn("fingerprint", F.get_json_object("summary", "$.input_fingerprint"))
    order = F.struct(F.coalesce("started_at", F.lit("0001-01-01").cast("timestamp")), "run_id")
    return done.groupBy("fingerprint").agg(F.max_by("run_id", order).alias("run_id"))


def completed_run(spark: SparkSession, root: str, fingerprint: str) -> str | None:
    """The newest completed run of the same input."""
    hit = newest_completed(_table(spark, f"{root}/runs", RUNS)).where(F.col("fingerprint") == fingerprint).first()
    return hit["run_id"] if hit else None


def persist(classified: DataFrame, root: str, internal_name: str, external_name: str, fingerprint: str, params_hash: str = "") -> tuple[str, bool]:
    """(run id, whether it was written): exceptions first, then the run's row, which makes them count.

    Exceptions of a run without its row (a writer that died) belong to no run. An input that has a
    completed run is not written again.
    """
    spark = classified.sparkSession
    known = completed_run(spark, root, fingerprint)
    if known is not None:
        return known, False
    run_id = str(uuid.uuid4())
    exception_rows(classified, run_id).write.mode("append").parquet(f"{root}/exceptions")
    matched, by = _counts(classified)
    run = summary_json(classified, fingerprint).select(
        F.lit(run_id).alias("run_id"), F.lit(internal_name).alias("internal_source"), F.lit(external_name).alias("external_source"), F.lit("completed").alias("status"),
        F.lit(matched).cast("long").alias("matched_count"), F.lit(sum(by.values())).cast("long").alias("exception_count"), "summary", F.lit(params_hash).alias("params_hash"), F.current_timestamp().alias("started_at"),
    )
    run.coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return run_id, True


def run_exceptions(spark: SparkSession, root: str) -> DataFrame:
    """The exceptions of finished runs."""
    return _table(spark, f"{root}/exceptions", EXCEPTIONS).join(_table(spark, f"{root}/runs", RUNS).where("status = 'completed'").select("run_id"), "run_id", "left_semi")
