"""Amounts in minor units: longs, never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minor(c: Column) -> Column:
    """A major-unit number of two decimals as minor units."""
    return F.round(c * 100).cast("long")


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def negate(a: Column) -> Column:
    return -a


def is_zero(a: Column) -> Column:
    return a == 0


def formatted(c: Column) -> Column:
    """123456 as 1234.56, -5 as -0.05. (A double holds no long exactly, so the division is of decimals.)"""
    size = F.abs(c)
    whole = ((size - size % 100).cast("decimal(20,0)") / 100).cast("long")
    return F.format_string("%s%d.%02d", F.when(c < 0, F.lit("-")).otherwise(F.lit("")), whole, size % 100)


def strict_integer(c: Column) -> Column:
    """Text of decimal digits with an optional sign as a long; null for anything else."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
