"""Mapping columns by what they hold: value and shape sketches of unnamed columns against those of known ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minimum hashes of a column's values, and of their shapes.
VALUE_HASHES, SHAPE_HASHES = 48, 16
#: Least share of a column's sketch that must agree with a known column's.
MIN_SCORE = 0.3
#: What agreement of the shapes counts against that of the values.
SHAPE_WEIGHT = 0.25
_MINIMA = [*(f"v{i}" for i in range(VALUE_HASHES)), *(f"s{i}" for i in range(SHAPE_HASHES))]


def shape(value: Column) -> Column:
    """What a value looks like: runs of digits as 9 and of letters as a, other signs as they are."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\p{N}+", "9"), r"\p{L}+", "a")


def plain(value: Column) -> Column:
    """A value without case and outer blanks; numbers in one spelling."""
    text = F.lower(F.trim(value))
    return F.when(text.rlike(r"^-?[0-9]+\.[0-9]*?0+$"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def sketch(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, filled, minima...) from (by, value): the least hash of the values, and of their shapes, per seed.

    One aggregate, combined before the shuffle; a column of any length is one row. Repeated values change nothing.
    Sketches of parts merge by least value (``merge``).
    """
    value, look = plain(F.col("value")), shape(F.col("value"))
    real = cells.where(F.trim("value") != "").select(*by, value.alias("_value"), look.alias("_shape"))
    values = [F.min(F.xxhash64(F.lit(i), "_value")).alias(f"v{i}") for i in range(VALUE_HASHES)]
    shapes = [F.min(F.xxhash64(F.lit(i), "_shape")).alias(f"s{i}") for i in range(SHAPE_HASHES)]
    return real.groupBy(*by).agg(F.count(F.lit(1)).alias("filled"), *values, *shapes)


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts as those of the whole, e.g. a known column's over all files that were mapped to it."""
    return sketches.groupBy(*by).agg(F.sum("filled").alias("filled"), *[F.min(m).alias(m) for m in _MINIMA])


def _agreement(prefix: str, n: int) -> Column:
    same = [(F.col(f"{prefix}{i}") == F.col(f"_{prefix}{i}")).cast("int") for i in range(n)]
    return sum(same[1:], same[0]) / n


def map_by_content(unknown: DataFrame, known: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(source, target_table, column, canonical, score) for the columns of ``unknown`` that a known column is like.

    ``unknown`` has sketches by (source, target_table, column), ``known`` by (target_table, canonical): one row per column of the
    catalog, a few hundred at most, so each unknown column is compared with all of its table. The score is the share of minimum
    hashes that agree, an estimate of the share of distinct values in common, with shapes as a smaller part. Each
    canonical column goes to one column of a source, the most alike; ties go to the earlier name.
    """
    names = {m: f"_{m}" for m in _MINIMA}
    pairs = unknown.join(known.drop("filled").withColumnsRenamed(names), "target_table")
    score = (1 - SHAPE_WEIGHT) * _agreement("v", VALUE_HASHES) + SHAPE_WEIGHT * _agreement("s", SHAPE_HASHES)
    scored = pairs.select("source", "target_table", "column", "canonical", F.round(score, 6).alias("score")).where(F.col("score") >= min_score)
    best = Window.partitionBy("source", "target_table", "column").orderBy(F.col("score").desc(), "canonical")
    first = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    once = Window.partitionBy("source", "target_table", "canonical").orderBy(F.col("score").desc(), "column")
    return first.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")


def fill_mapping(mapped: DataFrame, found: DataFrame) -> DataFrame:
    """``mapped`` (source, target_table, column, canonical) with what content says where the headers say nothing.

    A canonical column that some header of the source already names is not given a second time.
    """
    taken = mapped.where(F.col("canonical").isNotNull()).select("source", "target_table", "canonical").distinct()
    free = found.join(taken, ["source", "target_table", "canonical"], "left_anti")
    free = free.select("source", "target_table", "column", F.col("canonical").alias("_found"))
    out = mapped.join(free, ["source", "target_table", "column"], "left")
    return out.withColumn("canonical", F.coalesce("canonical", "_found")).select(*mapped.columns)
