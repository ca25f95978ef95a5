"""URL filters: glob rules on host and path, all simulated at once over each URL.

A rule is a host, a path and a verdict; it fits URLs whose host is the rule's or below it and whose
path starts with the rule's. ``*`` stands for any text without a slash in a path (within a host, for any part of it), ``**`` for any
text and ``?`` for one byte. Each rule is a chain of items over the canonical URL (a start byte, a dot, the host, an end-of-host byte, the path). The
chains lie one after the other in the bits of a few 64-bit words (Shift-And); a byte of all URLs of a
batch is taken at a time: shift, mask by the byte's word, and keep the bits whose item may repeat. The
longest rule (its written length) whose last bit stays set wins, the first of equals.

Results for odd input: a null URL or one without ``://`` has an empty host and path; URLs of any length are
judged whole; equal URLs are judged alike; without a fitting rule the rule is null and the verdict is
``default``; null and repeated keys are rows like others; an empty table gives no rows; other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that no UTF-8 text holds: the start, and the end of the host.
START, HOST_END = 0xFE, 0xFF
#: Bytes of the table of URLs that is simulated at a time.
AREA = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Masks of all rules: B[c] the items that byte c satisfies, L[c] those that stay on byte c."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = [h + p for h, p, _ in rules]
        self.verdicts = [v for _, _, v in rules]
        items: list[tuple[np.ndarray, np.ndarray]] = []
        any_byte, none = np.ones(256, bool), np.zeros(256, bool)
        in_host, in_part = any_byte.copy(), any_byte.copy()
        in_host[[START, HOST_END]] = False
        in_part[[START, HOST_END, ord("/")]] = False
        self.first, self.last = [], []
        for host, path, _ in rules:
            self.first.append(len(items))
            one = lambda c: np.arange(256) == c
            items.append((one(START), in_host))
            for b in (b"." + host.encode(), bytes([HOST_END]), path.encode()):
                wild = in_host if b[:1] == b"." else in_part
                i = 0
                while i < len(b):
                    if b[i : i + 2] == b"**":
                        items[-1] = (items[-1][0], items[-1][1] | (in_host if wild is in_host else any_byte))
                        i += 2
                    elif b[i] == ord("*"):
                        items[-1] = (items[-1][0], items[-1][1] | wild)
                        i += 1
                    else:
                        items.append((wild if b[i] == ord("?") else one(b[i]), none))
                        i += 1
            items[-1] = (items[-1][0], any_byte)  # a prefix of the path is enough
            self.last.append(len(items) - 1)
        self.words = max(1, -(-len(items) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        for i, (fits, stays) in enumerate(items):
            bit = np.uint64(1 << i % 64)
            self.step[fits, i // 64] |= bit
            self.stay[stays, i // 64] |= bit
        for i in self.first:
            self.begin[i // 64] |= np.uint64(1 << i % 64)
        self.order = sorted(range(len(rules)), key=lambda r: (-len(self.rules[r]), r))

    def winners(self, urls: list[bytes]) -> np.ndarray:
        """The winning rule of each canonical URL, -1 for none."""
        out = np.full(len(urls), -1, np.int64)
        length = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(length, kind="stable")
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * length[order[end]] <= AREA:
                end += 1
            rows = order[start:end]
            width = int(length[rows[-1]])
            table = np.frombuffer(b"".join(urls[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            state = np.zeros((len(rows), self.words), np.uint64)
            for p in range(width):
                live = np.searchsorted(length[rows], p, side="right")  # rows before it have ended
                byte = table[live:, p]
                now = state[live:]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[live:] = ((moved | self.begin) & self.step[byte]) | (now & self.stay[byte])
            won = np.full(len(rows), -1, np.int64)
            for r in reversed(self.order):
                i = self.last[r]
                won[(state[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)] = r
            out[rows] = won
            start = end
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``. No shuffle."""
    for host, path, _ in rules:
        if not host or path and path[0] not in "/*":
            raise ValueError(f"a rule needs a host, and a path that begins with a slash: {host}{path}")
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        head, end = bytes([START]) + b".", bytes([HOST_END])
        for batch in batches:
            hosts, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
            won = automaton.winners([head + h + end + p for h, p in zip(hosts, paths, strict=True)]).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "_key": batch.column("_key"),
                    "host": batch.column("host"),
                    "path": batch.column("path"),
                    "rule": pa.array([automaton.rules[r] if r >= 0 else None for r in won], pa.string()),
                    "verdict": pa.array([automaton.verdicts[r] if r >= 0 else default for r in won], pa.string()),
                }
            )

    return rows.mapInArrow(run, f"_key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("_key", key)
