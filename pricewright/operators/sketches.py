"""Column profiles that merge: sketches per file are stored, and a new file adds its own without reading the others again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a distinct-count sketch; its relative error is about 1.04 / sqrt(2 ** LG).
LG = 14
#: Values a frequent-value sketch follows at a time; a value with more than rows / FOLLOWED occurrences is never lost.
FOLLOWED = 1024
HLL_ERROR = 1.04 / 2 ** (LG / 2)


def sketch_columns(cells: DataFrame, by: Sequence[str] = ("file",), lg: int = LG, followed: int = FOLLOWED) -> DataFrame:
    """(by, column, rows, filled, shortest, longest, smallest, largest, distinct, frequent) from (by, column, value).

    ``rows`` and what follows up to ``largest`` are exact; ``distinct`` and ``frequent`` are sketches. One aggregate, combined before the
    shuffle: a group of any size is one row of bounded size.
    """
    value, length = F.col("value"), F.length("value")
    return cells.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("filled"), F.min(length).alias("shortest"), F.max(length).alias("longest"),
        F.min(value).alias("smallest"), F.max(value).alias("largest"),
        F.hll_sketch_agg(value, lg).alias("distinct"), F.expr(f"approx_top_k_accumulate(value, {followed}) FILTER (WHERE value IS NOT NULL)").alias("frequent"),
    )


def merge_sketches(stored: DataFrame, by: Sequence[str] = (), followed: int = FOLLOWED) -> DataFrame:
    """Stored sketches of many files as one per column (and per ``by``); the result can be merged further."""
    return stored.groupBy(*by, "column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "filled")], F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"),
        F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(frequent, {followed})").alias("frequent"),
    )


def profile_of(sketches: DataFrame, top: int = 5) -> DataFrame:
    """Sketches as a report: the exact columns, ``n_distinct`` as estimated, and the ``top`` values with their counts."""
    plain = [c for c in sketches.columns if c not in ("distinct", "frequent")]
    found = F.expr(f"approx_top_k_estimate(frequent, {top})")
    return sketches.select(*plain, F.hll_sketch_estimate("distinct").alias("n_distinct"), found.alias("frequent"))


def exact_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value, n): the exact counts that the sketches estimate, for reports that need them."""
    return cells.where(F.col("value").isNotNull()).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
