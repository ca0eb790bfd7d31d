"""Dashboard filters and the table builder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Months each named period reaches back from the client's last transaction.
PERIODS = {"Last 3mo": 3, "Last 6mo": 6, "Last 12mo": 12}


def filter_revenue(
    revenue: DataFrame,
    customers: DataFrame,
    segments: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    products: Sequence | None = None,
    period: str | None = None,
    client_id: str | None = None,
) -> DataFrame:
    """Facts of the chosen segments, regions, products and period, with the columns unchanged.

    Product and client filters reach the scan. Customer filters are a semi join. ``period`` is one of PERIODS or
    ``YTD`` and ends at each client's last transaction. These are one row per client and broadcast: a shuffle by client
    would give one task all facts of a client.
    """
    out = revenue
    if client_id is not None:
        out, customers = out.filter(F.col("client_id") == client_id), customers.filter(F.col("client_id") == client_id)
    if products:
        out = out.filter(F.col("product_sku").isin(list(products)))
    if period is not None:
        last = (revenue if client_id is None else revenue.filter(F.col("client_id") == client_id)).groupBy("client_id").agg(
            F.max("transaction_date").alias("_last")
        )
        if period == "YTD":
            start = F.trunc("_last", "year")
        elif period in PERIODS:
            start = F.date_add(F.add_months("_last", -PERIODS[period]), 1)
        else:
            raise ValueError(f"unknown period {period!r}")
        out = out.join(F.broadcast(last), "client_id").filter(F.col("transaction_date") >= start).drop("_last")
    if segments or regions:
        chosen = customers
        if segments:
            chosen = chosen.filter(F.col("customer_segment").isin(list(segments)))
        if regions:
            chosen = chosen.filter(F.col("geography_primary").isin(list(regions)))
        out = out.join(chosen.select("client_id", "customer_id"), ["client_id", "customer_id"], "left_semi")
    return out.select(*revenue.columns)


def build_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen columns in the chosen order; unknown or repeated names are refused."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown or not columns or len(set(columns)) != len(columns):
        raise ValueError(f"pick distinct columns of {df.columns}; not available: {unknown}")
    return df.select(*columns)


def grouped_sets(
    df: DataFrame, columns: Sequence[str], sums: Mapping[str, str], sets: Sequence[Sequence[str]] | None = None, count: str = "rows"
) -> DataFrame:
    """Totals over several combinations of ``columns`` at once: (columns, ``level``, ``sums``, ``count``).

    ``sums`` names each total and the column it adds up; without ``sets`` all combinations are there (a cube). ``level`` is
    the grouping id: a bit for each column, the first the highest, set where it is summed over, which tells a total from a
    null in the data. The facts are read and shuffled once, down to one row per full combination; the sets are
    written out from those few rows.
    """
    unknown = {c for s in sets or () for c in s} - set(columns)
    if unknown or len(set(columns)) != len(columns):
        raise ValueError(f"sets take distinct columns out of {list(columns)}; not available: {sorted(unknown)}")
    fine = df.groupBy(*columns).agg(*[F.sum(F.col(c)).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias(count))
    grouped = fine.cube(*columns) if sets is None else fine.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    totals = [F.sum(n).alias(n) for n in (*sums, count)]
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *totals).select(*columns, "level", *sums, count)


def export_csv(df: DataFrame, path: str) -> None:
    """Sharded CSV with a header in every part."""
    df.write.mode("errorifexists").option("header", True).csv(path)
