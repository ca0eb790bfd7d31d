"""As-of join: for each event the last value stated before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordering import keep_last


def as_of(events: DataFrame, history: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str]) -> DataFrame:
    """``events`` with the ``values`` of the latest row of ``history`` of the same ``keys`` whose ``since`` is not after ``at``.

    Both sides are one row of events in time, range-partitioned by key, time and a hash of the row, so that a key
    with any share of the rows is several slices. Within a slice the last value stated is carried forward; one small table
    has the last value of each key in each slice and hands it on to the key's later slices. Nothing is paired.

    Every event stays: with nulls where nothing was stated before, or where a key or ``at`` is null. History rows with a
    null key or date state nothing; of those with equal key and date the largest by ``values`` counts.
    """
    known = history.select(*keys, since, *values).dropna(subset=[*keys, since])
    known = keep_last(known, [*keys, since], F.struct(*values))
    row, value = F.struct(*[F.col(f"`{c}`") for c in events.columns]), F.struct(since, *values)
    # Of one moment the statement comes before the events.
    stated = known.select(*keys, F.col(since).alias("_time"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), value.alias("_value"))
    asked = events.select(*keys, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.xxhash64(*[F.col(f"`{c}`") for c in events.columns]).alias("_tie"), row.alias("_row"))
    both = stated.unionByName(asked, allowMissingColumns=True)
    order = ["_time", "_kind", "_tie"]
    sliced = materialise(both.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))

    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_time")))
    ends = sliced.groupBy(*keys, "_slice").agg(latest.alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]

    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = sliced.withColumn("_last", F.last("_value", ignorenulls=True).over(inside)).where("_kind = 1")
    out = own.join(carried, [F.col("_slice") == F.col("_s"), *same], "left").withColumn("_value", F.coalesce("_last", "_carried"))
    return out.select("_row.*", *[F.when(F.col("_time").isNotNull(), F.col("_value")[c]).alias(c) for c in (since, *values)])
