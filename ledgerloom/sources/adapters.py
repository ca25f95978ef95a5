"""Readers of ledger exports and settlement files: each gives canonical records with ``seq``, the file's order.

Strict by default: a malformed row ends the read with an error (``MalformedRow``), as a settlement must not be half
read; with ``quarantine`` bad rows are returned instead. Only the header line is looked at by the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import strict_integer
from ledgerloom.functions.text import parse_rfc3339, status_of_token, trimmed
from ledgerloom.schemas import RECORD, RECORD_STATUSES, RECORD_TYPES

# The columns of the fixed layout, in order; those of the free one that are needed and known.
FIXED_COLUMNS = ["session_id", "source_account", "beneficiary_account", "amount_kobo", "currency", "status", "transaction_date"]
FREE_REQUIRED, FREE_OPTIONAL = ["reference", "amount_minor"], ["currency", "source", "destination", "initiated_at", "status"]


class MalformedRow(ValueError):
    """A file whose header or rows do not fit its format."""


def _checked(value: Column, good: Column, message: str, line: Column) -> Column:
    """The value; reading it raises unless ``good``."""
    fail = F.raise_error(F.concat(F.lit(f"malformed row: {message}: "), F.coalesce(line.cast("string"), F.lit("null"))))
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(fail)


def numbered(rows: DataFrame) -> DataFrame:
    """``seq`` in the order of the files' names and of the lines in a file, without a shuffle or a count.

    ``rows`` is the reader's own DataFrame. A file's splits are read in order, so partition and position order its lines; of several files
    Spark reads the larger ones first, so a file's place among the sorted names goes in front.
    """
    files = sorted(rows.inputFiles())
    position = F.monotonically_increasing_id()
    if len(files) < 2:
        return rows.withColumn("seq", position)
    parts = rows.select(F.lit(1)).rdd.getNumPartitions()
    left = 63 - (len(files) - 1).bit_length() - (parts - 1).bit_length()
    if left < 28:
        raise ValueError(f"{len(files)} files in {parts} partitions leave no room for the order of lines")
    names = rows.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _name string")
    placed = rows.withColumn("_name", F.input_file_name()).withColumn("_at", position).join(F.broadcast(names), "_name")
    within = F.shiftleft(F.shiftright("_at", 33), left).bitwiseOR(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.withColumn("seq", F.shiftleft("_file", left + (parts - 1).bit_length()).bitwiseOR(within)).drop("_name", "_file", "_at")


def check_header(header: list[str], wanted: list[str]) -> None:
    if len(header) != len(wanted):
        raise MalformedRow(f"header has {len(header)} columns, expected {len(wanted)}")
    for i, (have, want) in enumerate(zip(header, wanted, strict=True)):
        if have.strip().lower() != want:
            raise MalformedRow(f"header column {i + 1} is {have.strip()!r}, expected {want!r}")


def header_of(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", False).option("inferSchema", False).csv(path).limit(1).collect()
    return [] if not first else ["" if x is None else str(x) for x in first[0]]


def read_ledger_json(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """JSON lines of canonical records. Amounts must be whole numbers; types and statuses of the known ones."""
    raw = T.StructType([*[f if f.name not in ("amount_minor",) else T.StructField("amount_minor", T.StringType()) for f in RECORD.fields], T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(raw).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    amount = strict_integer(F.col("amount_minor"))
    good = F.col("_bad").isNull() & amount.isNotNull() & F.coalesce(F.col("type").isin(*RECORD_TYPES), F.lit(False)) & F.coalesce(F.col("status").isin(*RECORD_STATUSES), F.lit(False))
    rows = numbered(rows)
    fields = [amount.alias("amount_minor") if f.name == "amount_minor" else F.coalesce(f.name, F.lit("")).alias(f.name) if f.name in ("reference", "source", "destination", "currency") else F.col(f.name) for f in RECORD.fields]
    if quarantine:
        return rows.select(*fields, "seq", (~good).alias("malformed"))
    checked = _checked(F.col("seq"), good, "record", F.coalesce("_bad", "reference"))
    return rows.select(*fields, checked.alias("seq"))


def _records(rows: DataFrame, reference: Column, source: Column, destination: Column, amount: Column, currency: Column, token: Column, at: Column, at_needed: bool, quarantine: bool) -> DataFrame:
    minor, status, when = strict_integer(amount), status_of_token(token), parse_rfc3339(at)
    good_time = when.isNotNull() if at_needed else (when.isNotNull() | (F.coalesce(at, F.lit("")) == ""))
    good = minor.isNotNull() & status.isNotNull() & good_time & ~F.coalesce(F.col("_ragged"), F.lit(False))
    none = F.lit(None)
    out = rows.select(
        none.cast("string").alias("transaction_id"), reference.alias("reference"), source.alias("source"), destination.alias("destination"), minor.alias("amount_minor"), currency.alias("currency"),
        F.lit("transfer").alias("type"), status.alias("status"), when.alias("initiated_at"), none.cast("timestamp").alias("settled_at"), none.cast("map<string,string>").alias("metadata"),
        ("seq" if quarantine else _checked(F.col("seq"), good, "settlement row", F.concat_ws(",", reference, amount, token, at)).alias("seq")), *([(~good).alias("malformed")] if quarantine else []),
    )
    return out


def _csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Rows of text, named by position, with _ragged for rows of too few or too many fields."""
    names = [f"_c{i}" for i in range(len(header))]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return numbered(reader.csv(path)).withColumn("_ragged", F.col("_bad").isNotNull())


def read_fixed_csv(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """The fixed layout: seven columns in order, every field trimmed, the date needed."""
    header = header_of(spark, path)
    check_header(header, FIXED_COLUMNS)
    rows = _csv(spark, path, header)
    c = [trimmed(F.coalesce(F.col(f"_c{i}"), F.lit(""))) for i in range(7)]
    return _records(rows, c[0], c[1], c[2], c[3], c[4], c[5], c[6], True, quarantine)


def read_free_csv(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """The header-driven layout: any order, unknown and ragged columns allowed, missing ones empty."""
    header = [h.strip().lower() for h in header_of(spark, path)]
    for name in FREE_REQUIRED:
        if name not in header:
            raise MalformedRow(f"header has no column {name!r}")
    rows = _csv(spark, path, header).withColumn("_ragged", F.lit(False))
    at = lambda n: trimmed(F.coalesce(F.col(f"_c{len(header) - 1 - header[::-1].index(n)}"), F.lit(""))) if n in header else F.lit("")
    return _records(rows, at("reference"), at("source"), at("destination"), at("amount_minor"), at("currency"), at("status"), at("initiated_at"), False, quarantine)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records as Parquet; ``seq`` is taken from the table if it has one."""
    rows = spark.read.parquet(path)
    return rows if "seq" in rows.columns else numbered(rows)


#: Settlement file formats by name; a reader takes (spark, path).
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"nibss": read_fixed_csv, "csv": read_free_csv, "parquet": read_parquet, "jsonl": read_ledger_json}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a format of one's own."""
    FORMATS[name] = reader


def read_external(spark: SparkSession, path: str, format: str) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"unknown external format {format!r}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[format](spark, path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """SHA-256 over the inputs' bytes in order, each followed by a zero byte; any file system Spark reads.

    A file streams through the driver in pieces of a megabyte: a digest is sequential, its memory is constant. A folder's
    files are hashed by executors, and its bytes are their digests in the order of their names, so
    its fingerprint is not that of one file with the same lines.
    """
    import hashlib

    h = hashlib.sha256()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.getFileStatus(p).isDirectory():
            files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))
            for row in files.orderBy("path").toLocalIterator():
                h.update(bytes.fromhex(row["digest"]))
        else:
            stream = fs.open(p)
            try:
                while piece := bytes(stream.readNBytes(1 << 20)):
                    h.update(piece)
            finally:
                stream.close()
        h.update(b"\0")
    return h.hexdigest()
