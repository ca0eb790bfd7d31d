"""Type repair and cleaning of one table, with a log of every change."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import BOOLEANS, NUMERIC_FRAGMENTS, NUMERICS
from ..functions.dates import is_serial, parse_timestamp
from ..functions.text import blank_to_null, parse_bool
from . import date_order

LOG_SCHEMA = "table string, column string, action string, affected long, detail string"

# Optional column telling where a row stood in its source; no part of the data.
POSITION = "_position"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def as_number(value: Column) -> Column:
    """The number a text holds; texts with neither a digit nor a word for infinity or NaN are not tried, as failed casts are slow."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"[0-9]|(?i:inf|nan)"), text.try_cast("double"))


def declared_kinds(columns: Iterable[str]) -> dict[str, str]:
    """Kinds the catalog fixes: these win over any guess from the name."""
    kinds = {}
    for name in columns:
        if name in BOOLEANS:
            kinds[name] = "boolean"
        elif name in NUMERICS:
            kinds[name] = "number"
        elif name.endswith("_date"):
            kinds[name] = "date"
    return kinds


def guess_kinds(df: DataFrame, known: Mapping[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """(kinds of the columns the catalog does not know, order of day and month of all date columns).

    A name holding ``date`` or a numeric fragment is a candidate; it counts when at least half of the non-null values
    parse, so that text columns such as price_tier stay text. One pass; the driver sees a few counts per candidate.
    """
    texts = {n for n, t in df.dtypes if t == "string"}
    candidates = {}
    for name in df.columns:
        if name in known:
            continue
        low = name.lower()
        if "date" in low:
            parsed = F.coalesce(*[parse_timestamp(_c(name), order=o) for o in ("month", "day")])
            candidates[name] = ("date", parsed)
        elif any(f in low for f in NUMERIC_FRAGMENTS):
            candidates[name] = ("number", as_number(_c(name)))
    written = [n for n in df.columns if n in texts and (known.get(n) == "date" or candidates.get(n, ("",))[0] == "date")]
    if not candidates and not written:
        return {}, {}
    read = df.select(*date_order.vote_columns(written), *[
        c for i, (n, (_, parsed)) in enumerate(candidates.items())
        for c in (blank_to_null(_c(n)).alias(f"n{i}"), parsed.alias(f"p{i}"))
    ])
    counts = read.agg(*date_order.vote_counts(written), *[F.count(f"{c}{i}").alias(f"{c}{i}") for i in range(len(candidates)) for c in "np"]).first()
    kinds = {
        n: kind for i, (n, (kind, _)) in enumerate(candidates.items()) if counts[f"n{i}"] and 2 * counts[f"p{i}"] >= counts[f"n{i}"]
    }
    return kinds, date_order.column_orders(counts, written)


def typed(name: str, kind: str | None, order: str | None = None) -> Column:
    value = _c(name)
    if kind == "date":
        return parse_timestamp(value, order=order).alias(name)
    if kind == "number":
        return as_number(value).alias(name)
    return value.alias(name)


def clean(df: DataFrame, table: str, kinds: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and its log.

    Order: dates (serials first), numbers, empty rows, exact duplicates, then trimming and null tokens. Duplicates are
    therefore judged before trimming, and rows differing in blanks only both stay. Duplicates fall to one aggregation
    that is combined before the shuffle, so many copies of one row are no hot spot. A ``_position`` column is carried
    along; of repeated rows the first stays. A text column of dates is read in the one order of day and month that more of
    its values ask for.
    """
    known = declared_kinds(df.columns) if kinds is None else kinds
    guessed, orders = guess_kinds(df if kinds is None else df.select(*[_c(n) for n, k in known.items() if k == "date"]), known)
    kinds = {**known, **guessed} if kinds is None else kinds
    names = [c for c in df.columns if c != POSITION]
    places = [c for c in df.columns if c == POSITION]
    repaired = df.select(*[typed(n, kinds.get(n), orders.get(n)) for n in names], *places)
    # Spark tests this on the values before repair; repaired columns come last, so that few of them are read for it.
    plain_first = sorted(names, key=lambda n: ("number", "date").index(kinds[n]) if kinds.get(n) in ("number", "date") else -1)
    filled = repaired.filter(F.coalesce(*[_c(n).cast("string") for n in plain_first]).isNotNull())
    unique = filled.groupBy(*[_c(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"), *[F.min(p).alias(p) for p in places])
    out = unique.select(*[
        parse_bool(_c(n)).alias(n) if kinds.get(n) == "boolean"
        else (blank_to_null(_c(n)).alias(n) if t == "string" else _c(n))
        for n, t in repaired.dtypes
    ])
    return out, cleaning_log(df, unique, table, kinds, orders)


def cleaning_log(df: DataFrame, unique: DataFrame, table: str, kinds: Mapping[str, str], orders: Mapping[str, str]) -> DataFrame:
    """One row per kind of change with the number of values or rows it touched; untouched ones are left out.

    Dates that could be read in either order count as guessed if as many values of the column ask for one order as for the other.
    """
    read, counts, labels = [], [], []

    def seen(value: Column) -> Column:
        """The value as a column below the counts: worked out once per row, however many counts use it."""
        read.append(value.alias(f"v{len(read)}"))
        return F.col(f"v{len(read) - 1}")

    def add(column: str | None, action: str, count: Column, detail: str) -> None:
        counts.append(F.coalesce(count, F.lit(0)).cast("long").alias(f"k{len(labels)}"))
        labels.append((column, action, detail))

    for name, kind in kinds.items():
        if kind == "date":
            add(name, "convert_serial_dates", F.count_if(seen(is_serial(_c(name)))), "spreadsheet serial numbers converted")
            day = seen(parse_timestamp(_c(name), order=orders.get(name)))
            add(name, "flag_1970_dates", F.count_if(F.year(day) == 1970), "dates that may come from a zero epoch")
            if name in orders:
                cast = {n: F.count_if(v) for n, v in date_order.votes(seen(date_order.vote(_c(name)))).items()}
                guessed = F.when(cast["month_only"] == cast["day_only"], cast["either"])
                add(name, "guess_date_order", guessed, f"dates that fit both orders, read {orders[name]}-first without evidence")
                add(name, "coerce_dates", F.count(seen(blank_to_null(_c(name)))) - F.count(day), "values that are no dates became null")
        elif kind == "number":
            lost = F.count(seen(_c(name))) - F.count(seen(as_number(_c(name))))
            add(name, "coerce_numeric", lost, "values that are no numbers became null")
    changed = df.select(*read).agg(F.count(F.lit(1)).alias("rows_in"), *counts)
    kept = unique.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_filled"), F.count(F.lit(1)).alias("rows_out"))
    labels += [
        (None, "drop_empty_rows", "rows without any value"),
        (None, "drop_duplicates", "repeated rows"),
    ]
    entries = [
        F.struct(
            F.lit(table).alias("table"), F.lit(column).cast("string").alias("column"), F.lit(action).alias("action"),
            affected.alias("affected"), F.lit(detail).alias("detail"),
        )
        for (column, action, detail), affected in zip(
            labels,
            [F.col(f"k{i}") for i in range(len(counts))]
            + [F.col("rows_in") - F.col("rows_filled"), F.col("rows_filled") - F.col("rows_out")],
        )
    ]
    # Both sides are one row each.
    return (
        changed.withColumn("_one", F.lit(1)).join(kept.withColumn("_one", F.lit(1)), "_one")
        .select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(F.col("affected") > 0)
    )


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    return df.select(*[
        F.when(F.isnan(_c(n)) | (F.abs(_c(n)) == float("inf")), None).otherwise(_c(n)).alias(n) if t in ("double", "float") else _c(n)
        for n, t in df.dtypes
    ])


def without_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Each row as a JSON payload that leaves null keys out."""
    names = list(columns or df.columns)
    return sanitize(df).select(F.to_json(F.struct(*[_c(n) for n in names]), {"ignoreNullFields": "true"}).alias("payload"))
