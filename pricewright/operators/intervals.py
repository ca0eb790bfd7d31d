"""Joining dated rows to date windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days that share one join key.
SPAN_DAYS = 32


def span(day: Column, days: int = SPAN_DAYS) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)


def within(rows: DataFrame, windows: DataFrame, keys: Sequence[str], day: str, first: str, last: str, days: int = SPAN_DAYS) -> DataFrame:
    """Inner join of ``rows`` and ``windows`` on ``keys`` where ``day`` lies in [``first``, ``last``].

    Days are cut into spans; a window is written once per span it touches, so both sides meet by equality on keys and
    span. Only days in the first and last span of a window are tested in vain, and a key with most of the rows is
    spread over its spans. Windows are cut to the days that ``rows`` has at all, so an open end costs no spans. ``rows`` should hold few rows per key and day: aggregate first. Windows with a missing or
    reversed date match nothing.
    """
    extent = rows.agg(F.min(day).alias("_low"), F.max(day).alias("_high"))
    valid = windows.filter(F.col(first) <= F.col(last)).join(F.broadcast(extent)).filter(
        (F.col(first) <= F.col("_high")) & (F.col(last) >= F.col("_low"))
    )
    low, high = F.greatest(F.col(first), F.col("_low")), F.least(F.col(last), F.col("_high"))
    spread = valid.withColumn("_span", F.explode(F.sequence(span(low, days), span(high, days)))).drop("_low", "_high")
    placed = rows.withColumn("_span", span(F.col(day), days))
    return placed.join(spread, [*keys, "_span"]).filter(F.col(day).between(F.col(first), F.col(last))).drop("_span")
