"""Registered queries: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import gold
from .bindings import Bindings

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so that every reader sees the same value."""
    return df.select(*[
        F.col(f"`{n}`").cast("string").alias(n) if t in ("date", "timestamp") else F.col(f"`{n}`") for n, t in df.dtypes
    ])


def _view(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return plain(gold.view(name, Bindings(spark, folder).table))


QUERIES: dict[str, Query] = {name: partial(_view, name) for name in gold.VIEWS}
