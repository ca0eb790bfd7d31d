"""Exact money, ratios that survive a zero denominator, and ordered bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    return as_col(value).cast(MONEY)


def num(value: Column | str) -> Column:
    return as_col(value).cast("double")


def total(value: Column | str) -> Column:
    """Exact sum of a money column, independent of row order."""
    return F.sum(money(value))


def ratio(part: Column | str, whole: Column | str) -> Column:
    return num(part) / F.nullif(num(whole), F.lit(0.0))


def percent(part: Column | str, whole: Column | str) -> Column:
    return ratio(part, whole) * 100


def thousands(value: Column | str) -> Column:
    return num(value) / 1000


def mean_of(value: Column | str) -> Column:
    """Average as sum over count, so that an exact sum gives the same mean on any partitioning."""
    return ratio(total(value), F.count(as_col(value)))


def round_half_up(value: Column, digits: int) -> Column:
    """Round through a decimal: ties go away from zero, as written, not as stored in binary."""
    return F.round(value.cast("decimal(28,6)"), digits).cast("double")


def fixed_sum(value: Column | str, digits: int = 6) -> Column:
    """Sum of doubles as integers of 10^-digits each: the result does not depend on row order."""
    scaled = num(value) * float(10**digits) + 0.5
    whole = scaled - F.pmod(scaled, F.lit(1.0))  # floor() would squeeze the value into 64 bits
    return num(F.sum(whole.cast("decimal(28,0)"))) / float(10**digits)


def clean_number(value: Column | str) -> Column:
    """NaN and infinities count as missing."""
    v = num(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def band(value: Column | str, edges: Sequence[float], labels: Sequence[str], closed: str = "left") -> Column:
    """Struct(label, rank) of the band holding ``value``.

    ``closed='left'``: a band holds its lower edge, but the last one starts strictly above its edge.
    ``closed='right'``: a band holds its upper edge.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges")
    v = as_col(value)

    def entry(i: int) -> Column:
        return F.struct(F.lit(labels[i]).alias("label"), F.lit(i + 1).alias("rank"))

    last = len(edges) - 1
    out = F.when(v.isNull(), None)
    for i, edge in enumerate(edges):
        inside = v <= F.lit(edge) if closed == "right" or i == last else v < F.lit(edge)
        out = out.when(inside, entry(i))
    return out.otherwise(entry(last + 1))
