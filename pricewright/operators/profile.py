"""Profiles of tables and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import percent


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _cut(value: Column | str, width: int | None) -> Column:
    return F.col(value) if width is None and isinstance(value, str) else value if width is None else F.substring(value, 1, width)


def fill_rates(df: DataFrame, keys: Sequence[str] = (), low: float = 80.0) -> DataFrame:
    """Share of non-null values per column, one aggregation whatever the number of columns."""
    names = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("filled")) for i, c in enumerate(names)])
    rate = percent("e.filled", F.greatest("_n", F.lit(1)))
    return counts.withColumn("e", F.explode(entries)).select(
        *keys, "e.column", F.col("_n").alias("rows"), "e.filled", rate.alias("fill_pct"), (rate < low).alias("is_low")
    )


def unpivot_text(df: DataFrame, order: Column, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), _text(c).alias("value")) for i, c in enumerate(columns)])
    return df.select(order.alias("row_num"), F.explode(cells).alias("c")).select("row_num", "c.*")


def profile(
    df: DataFrame, order: Column, max_columns: int | None = None, sampled: int | None = None, samples: int = 3, width: int | None = None
) -> DataFrame:
    """One row per named column: table size, and its first non-null values.

    Each task keeps its first few values per column before anything is shuffled. The limits shorten the report for a
    reader: to the leading columns, samples of fewer of them, and values cut to a width. By default all is there.
    """
    named = [c for c in df.columns if not c.startswith("Unnamed")][:max_columns]
    size = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("_one", F.lit(1))
    cells = unpivot_text(df, order, named[:sampled]).filter(F.col("value").isNotNull())
    first = Window.partitionBy("column").orderBy("row_num", "value")
    kept = cells.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= samples)
    texts = kept.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", _cut("value", width).alias("v")))), lambda s: s["v"]).alias("samples")
    )
    columns = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(named)], "position int, column string").withColumn("_one", F.lit(1))
    return columns.join(size, "_one").join(texts, "column", "left").select(
        "position", "column", "rows", F.lit(len(df.columns)).alias("columns"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples")
    )


def inventory(cells: DataFrame, samples: int = 5, width: int | None = None) -> DataFrame:
    """Distinct column names over many tables with their smallest distinct values.

    ``cells`` is (column, value). Values are made distinct first, so a value repeated everywhere is one row, and each
    task keeps only ``samples`` values per column. ``width`` cuts the samples shown, not the values compared.
    """
    named = cells.select(F.trim("column").alias("column"), "value").filter(F.length("column") > 0)
    values = named.filter(F.col("value").isNotNull()).distinct()
    first = Window.partitionBy("column").orderBy("value")
    kept = values.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= samples)
    texts = kept.groupBy("column").agg(F.transform(F.array_sort(F.collect_list("value")), lambda v: _cut(v, width)).alias("samples"))
    counts = named.groupBy("column").agg(F.count("value").alias("filled"))
    return counts.join(texts, "column", "left").select("column", "filled", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
