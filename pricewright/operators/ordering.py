"""Row numbers and running sums over data too large for one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    number: str | None = None,
    chunk: Column | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums and/or a 1-based row number per ``keys`` in ``order``, which must be total.

    Rows with a null key are a group of their own. No group is handled by one task. Rows are cut into ordered slices; each slice is summed, the small table of
    slice sums gives every slice its starting value, and the inside of a slice is a window of bounded size.
    ``chunk`` is a deterministic slice number that grows with the order; with it the whole plan stays lazy.
    Without it slices come from a range partitioning, materialised once so that every reader sees the same cut.
    ``totals`` (column -> name of a sum) adds the sum over the whole group, which the slice sums give for free.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    if chunk is None:
        sliced = materialise(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()))
    else:
        sliced = df.withColumn("_slice", chunk)

    # Structs are equal where their fields are, nulls included, so that a join on the group loses no row.
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    sliced = sliced.withColumn("_group", group)
    slice_keys = ["_group", "_slice"]
    slice_sums = [F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()]
    per_slice = sliced.groupBy(*slice_keys).agg(F.count(F.lit(1)).alias("_rows"), *slice_sums)
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        *slice_keys,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_start"),
        *[F.sum(f"_sum_{name}").over(before).alias(f"_start_{name}") for name in sums],
        *[F.sum(f"_sum_{name}").over(Window.partitionBy("_group")).alias(out) for out, name in totals.items()],
    )
    inside = Window.partitionBy(*slice_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.join(starts, slice_keys)
    added: dict[str, Column] = {}
    for name, c in sums.items():
        own = F.sum(c).over(inside)
        added[name] = F.when(F.col(f"_start_{name}").isNull(), own).otherwise(own + F.col(f"_start_{name}"))
    if number:
        added[number] = F.row_number().over(inside) + F.col("_row_start")
    out = out.withColumns(added)
    return out.select(*df.columns, *added, *totals)


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row per key by ``order``; null keys form one group. Map-side combined, so a hot key is harmless.

    Rows without an order come first; of rows with equal order the largest by value stays, whatever the partitioning.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    groups = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]
    return df.groupBy(*groups).agg(F.max_by(row, F.struct(order.isNotNull(), order, row)).alias("_row")).select("_row.*")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(keys, one column per share, _rows): the smallest value that at least that share of a group's values reach.

    Equal values are counted first; the counts are then summed over ordered slices, so the result is exact and no group is
    gathered in one task. Null values count for ``_rows`` only; a group of nothing else has null percentiles.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    upto = running(counted.where(F.col(value).isNotNull()), keys, [F.col(value)], {"_upto": F.col("_count")})
    there = F.when(F.col(value).isNotNull(), F.col("_count")).otherwise(0)
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    sizes = counted.groupBy(*keys).agg(F.sum("_count").alias("_rows"), F.sum(there).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    placed = sizes.join(upto.withColumnsRenamed(names), same, "left")

    def edge(share: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(share).cast("decimal(10,6)")))
        return F.min(F.when(F.col("_upto") >= rank, F.col(value)))

    return placed.groupBy(*keys).agg(*[edge(s).alias(name) for name, s in shares.items()], F.max("_rows").alias("_rows"))
