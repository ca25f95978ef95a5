"""The simulated rail: 64-bit FNV-1a of (seed, reference, dimension) as a number in [0, 1).

A batch of references is hashed at once with arrays of unsigned 64-bit numbers, a byte of all of them at a time, in a
vectorised function; only the references go to it, and all dimensions of a reference share its hash so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 64-bit FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def _hasher(seed: int, dimensions: tuple[str, ...]) -> Callable:
    before = seed.to_bytes(8, "little", signed=True)
    offset, prime = OFFSET, PRIME

    def hashed(references):
        import numpy as np
        import pandas as pd

        raw = [r.encode() if isinstance(r, str) else b"" for r in references]
        width = max(map(len, raw), default=0)
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width).astype(np.uint64)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        state = np.full(len(raw), offset, np.uint64)
        for byte in before:
            state = (state ^ np.uint64(byte)) * np.uint64(prime)
        for i in range(width):
            state = np.where(i < size, (state ^ data[:, i]) * np.uint64(prime), state)
        out = []
        for name in dimensions:
            own = state
            for byte in b"\0" + name.encode():
                own = (own ^ np.uint64(byte)) * np.uint64(prime)
            # In two halves, each exact in a double, so the sum is rounded once.
            out.append(((own >> np.uint64(32)).astype(np.float64) * 4294967296.0 + (own & np.uint64(0xFFFFFFFF)).astype(np.float64)) / 18446744073709551616.0)
        drawn = np.stack(out, axis=1)
        return pd.Series([None if r is None else x for r, x in zip(references, drawn.tolist(), strict=True)])

    return hashed


def draws(seed: int, reference: Column, *dimensions: str) -> Column:
    """The numbers in [0, 1) of the dimensions, as an array; null for a null reference. The same in any order of evaluation."""
    return F.pandas_udf(_hasher(seed, dimensions), "array<double>")(reference)


def u01(seed: int, reference: Column, dimension: str) -> Column:
    """The number of one dimension."""
    return draws(seed, reference, dimension)[0]


def fires(p: float, drawn: Column) -> Column:
    return F.lit(False) if p <= 0 else F.lit(True) if p >= 1 else drawn < p


class Chaos:
    """Probabilities of the simulated rail's faults."""

    def __init__(self, seed: int = 42, timeout: float = 0.25, decline: float = 0.30, duplicate: float = 0.50, tsq_timeout: float = 0.30):
        self.seed, self.timeout, self.decline, self.duplicate, self.tsq_timeout = seed, timeout, decline, duplicate, tsq_timeout

    #: The rail's dimensions, in the order of the draws.
    DIMENSIONS = ("send_timeout", "decline", "duplicate", "tsq_timeout")

    def drawn(self, reference: Column) -> Column:
        return draws(self.seed, reference, *self.DIMENSIONS)

    def sends(self, drawn: Column) -> dict[str, Column]:
        """Whether each fault fires, by a reference's draws."""
        return {
            "send_timeout": fires(self.timeout, drawn[0]),
            "declined": fires(self.decline, drawn[1]),
            "duplicate": fires(self.duplicate, drawn[2]),
            "tsq_timeout": fires(self.tsq_timeout, drawn[3]),
        }


def send_verdict(timeout: Column, declined: Column) -> Column:
    return F.when(timeout, "unknown").when(declined, "declined").otherwise("success")


def query_verdict(tsq_timeout: Column, declined: Column) -> Column:
    return F.when(tsq_timeout, "unknown").when(declined, "declined").otherwise("success")


def terminal(timeout: Column, declined: Column, tsq_timeout: Column) -> Column:
    """Where a transfer must end: a send without an answer is decided by the query, or held."""
    return F.when(timeout & tsq_timeout, "manual_review").when(declined, "reversed").otherwise("settled")
