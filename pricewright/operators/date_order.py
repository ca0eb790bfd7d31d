"""Day-first or month-first: the order of numeric dates, voted by what each column of each file holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DAY_FIRST, MONTH_FIRST, numeric_dates, numeric_separator
from ..functions.text import once

#: Counts of one column: what only the month-first order explains, only the day-first one, both.
VOTES = ("month_only", "day_only", "either")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def vote(value: Column) -> Column:
    """The name in ``VOTES`` that one value counts for; null for what is no numeric date. Each order is read once."""
    def cast(told: Column) -> Column:
        return F.when(told["month"] & told["day"], VOTES[2]).when(told["month"], VOTES[0]).when(told["day"], VOTES[1])

    return once(numeric_dates(value, lambda read: F.struct(*[read[o].isNotNull().alias(o) for o in (MONTH_FIRST, DAY_FIRST)])), cast)


def votes(cast: Column) -> dict[str, Column]:
    """Conditions on a column that holds ``vote``, by the names of ``VOTES``; all are false for what is no numeric date."""
    return {n: F.coalesce(cast == n, F.lit(False)) for n in VOTES}


def winner(month_only: Column, day_only: Column, dotted: Column) -> Column:
    """The order with more values that only it explains; without any, dates with dots are day-first and others month-first."""
    usual = F.when(dotted, F.lit(DAY_FIRST)).otherwise(F.lit(MONTH_FIRST))
    return F.when(day_only > month_only, F.lit(DAY_FIRST)).when(month_only > day_only, F.lit(MONTH_FIRST)).otherwise(usual)


def evidence(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, separator, month_only, day_only, either): numeric dates per column and way of writing.

    One aggregate, combined before the shuffle; its result is as small as there are files times columns.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in columns]))
    long = df.select(*[_c(b) for b in by], cells.alias("cell")).select(*by, "cell.*").withColumn("separator", numeric_separator("value"))
    counts = [F.count_if(v).alias(n) for n, v in votes(F.col("vote")).items()]
    cast = long.where(F.col("separator").isNotNull()).withColumn("vote", vote(F.col("value")))
    found = cast.groupBy(*by, "column", "separator").agg(*counts)
    return found.where(" + ".join(VOTES) + " > 0")


def orders(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, month_only, day_only, either, order, ambiguous): one order per column, and per ``by`` where given.

    A column is ambiguous if as many values, perhaps none, speak for one order as for the other; its order is a guess.
    """
    found = evidence(df, columns, by)
    dots = F.sum(F.when(F.col("separator") == ".", F.col("either")).otherwise(0))
    per_column = found.groupBy(*by, "column").agg(*[F.sum(v).alias(v) for v in VOTES], dots.alias("dots"))
    order = winner(F.col("month_only"), F.col("day_only"), 2 * F.col("dots") > F.col("either"))
    return per_column.select(*by, "column", *VOTES, order.alias("order"), (F.col("month_only") == F.col("day_only")).alias("ambiguous"))


def with_orders(df: DataFrame, columns: Sequence[str], by: Sequence[str], name: str = "_orders") -> DataFrame:
    """Add a map column -> order, the same for all rows of a ``by`` group; columns without numeric dates are not in it."""
    told = orders(df, columns, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "order"))).alias(name))
    renamed = told.withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)})
    # Without groups the counts are one row for all.
    same = [_c(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)] or F.lit(True)
    return df.join(renamed, same, "left").select(*[_c(c) for c in df.columns], name)


def column_orders(counts: Mapping[str, int], columns: Sequence[str]) -> dict[str, str]:
    """Orders from the counts of ``vote_counts`` of whole columns."""
    out = {}
    for i, c in enumerate(columns):
        month, day, either, dots = (counts[f"{v}{i}"] for v in (*VOTES, "dots"))
        out[c] = DAY_FIRST if day > month or (day == month and 2 * dots > either) else MONTH_FIRST
    return out


def vote_columns(columns: Sequence[str]) -> list[Column]:
    """What ``vote_counts`` counts, one column each, to be selected below it so that every value is read once."""
    out = []
    for i, c in enumerate(columns):
        text = _c(c).cast("string")
        out += [vote(text).alias(f"_vote{i}"), text.contains(".").alias(f"_dotted{i}")]
    return out


def vote_counts(columns: Sequence[str]) -> list[Column]:
    """Aggregates for ``column_orders`` over ``vote_columns``, to be taken in a pass that runs anyway."""
    out = []
    for i in range(len(columns)):
        cast = votes(F.col(f"_vote{i}"))
        out += [F.count_if(v).alias(f"{n}{i}") for n, v in cast.items()]
        out.append(F.count_if(cast["either"] & F.col(f"_dotted{i}")).alias(f"dots{i}"))
    return out
