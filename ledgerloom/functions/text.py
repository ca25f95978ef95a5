"""Text as external files spell it: white space, status tokens, times, keys, fingerprints."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens external files use for a status, and the token written for each.
STATUS_TOKENS = {
    "00": "settled", "SUCCESS": "settled", "SUCCESSFUL": "settled", "SETTLED": "settled", "COMPLETED": "settled",
    "01": "pending", "PENDING": "pending",
    "09": "failed", "91": "failed", "FAILED": "failed", "DECLINED": "failed",
    "REVERSED": "reversed",
    "TIMEOUT": "timed_out", "TIMED_OUT": "timed_out",
}
TOKEN_OF_STATUS = {"settled": "00", "pending": "01", "failed": "09", "reversed": "REVERSED", "timed_out": "TIMEOUT", "debited": "01"}
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def status_of_token(c: Column, strict: bool = False) -> Column:
    """The status behind a token in any case; empty means settled. Unknown tokens are null, or raise if ``strict``."""
    token = F.upper(trimmed(F.coalesce(c, F.lit(""))))
    known = F.when(token == "", F.lit("settled")).otherwise(F.try_element_at(_lookup(STATUS_TOKENS), token))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown status token: "), token)).cast("string")) if strict else known


def token_of_status(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(TOKEN_OF_STATUS), c), F.lit("00"))


def parse_rfc3339(c: Column) -> Column:
    """A full date and time with an offset; null for anything else (bare dates included)."""
    return F.when(c.rlike(_RFC3339), F.try_to_timestamp(c))


def format_rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def leg_key(transfer_id: Column, leg: str | Column) -> Column:
    return F.concat_ws(":", transfer_id, F.lit(leg) if isinstance(leg, str) else leg)


def request_fingerprint(source: Column, destination: Column, amount: Column, currency: Column, reference: Column, as_json: bool = True) -> Column:
    """SHA-256 over a request's fields in a fixed order: JSON as services send it, or joined by bars."""
    if as_json:
        body = F.to_json(F.struct(source.alias("source"), destination.alias("destination"), amount.alias("amount_minor"), currency.alias("currency"), reference.alias("reference")))
        for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
            body = F.replace(body, F.lit(sign), F.lit(code))
    else:
        body = F.concat_ws("|", source, destination, amount.cast("string"), currency, reference)
    return F.sha2(body.cast("binary"), 256)


def merge_metadata(old: Column, new: Column) -> Column:
    """Both maps' entries, the new one's where a key is in both."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
