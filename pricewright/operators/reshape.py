"""Apply mapping decisions to sheets: exclusion rules, long projection, wide-to-long, canonical shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import TABLES, Table, column_type
from ..functions.dates import parse_date
from ..functions.text import blank_to_null, customer_key, parse_bool
from .headers import WIDE_FROM, date_positions, month_positions

DECISION_SCHEMA = (
    "file string, sheet string, target_table string, column_mapping map<string,string>, data_format string, "
    "exclude_rules array<string>, id_columns array<string>"
)
WIDE_FORMATS = ("wide_dates", "wide_months")

# Fixed value: smaller amounts in a wide sheet are treated as empty.
SMALLEST_AMOUNT = 0.01


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---- frames whose columns are already named -------------------------------------------------------------------


def exclude_totals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which any of the columns (default: all) mentions a total, in any case."""
    texts = F.array(*[F.lower(_c(n).cast("string")) for n in columns or df.columns])
    return df.filter(~F.exists(texts, lambda t: F.coalesce(t.contains("total"), F.lit(False))))


def exclude_blank_ids(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Keep rows with a non-blank value in the first id column that exists."""
    name = next((c for c in id_columns if c in df.columns), None)
    return df if name is None else df.filter(F.trim(_c(name).cast("string")) != "")


def apply_exclusions(df: DataFrame, rules: Sequence[str], id_columns: Sequence[str] = ()) -> DataFrame:
    for rule in (r.lower() for r in rules):
        if "total" in rule:
            df = exclude_totals(df)
        if any(w in rule for w in ("blank", "empty", "nan")):
            df = exclude_blank_ids(df, id_columns)
    return df


def long_project(df: DataFrame, mapping: Mapping[str, str | None], min_fields: int = 2) -> DataFrame:
    """Mapped columns under their canonical names; of several sources the last with a value wins.

    Rows with fewer than ``min_fields`` values are dropped.
    """
    sources: dict[str, list[str]] = {}
    for source, canonical in mapping.items():
        if canonical and canonical != "null" and source in df.columns:
            sources.setdefault(canonical, []).append(source)
    out = df.select(*[F.coalesce(*[_c(s) for s in reversed(names)]).alias(c) for c, names in sources.items()])
    present = sum((_c(c).isNotNull().cast("int") for c in out.columns), F.lit(0))
    return out.filter(present >= min_fields)


def wide_unpivot(df: DataFrame, statics: Mapping[str, str], dates: Mapping[str, str]) -> DataFrame:
    """One row per static row and date column holding an amount: transaction_date and revenue (two decimals).

    ``dates`` maps column to ISO date. Rows without any static value, text and amounts below a cent are dropped.
    """
    base = long_project(df.select(*statics, *dates), {**statics, **{d: f"_d{i}" for i, d in enumerate(dates)}}, 0)
    names = list(dict.fromkeys(statics.values()))
    filled = base.filter(F.coalesce(*[_c(n).cast("string") for n in names]).isNotNull())
    cells = F.array(*[
        F.struct(F.lit(day).cast("date").alias("day"), _c(f"_d{i}").cast("string").alias("value")) for i, day in enumerate(dates.values())
    ])
    long = filled.select(*[_c(n) for n in names], F.explode(cells).alias("_cell"))
    amount = F.trim(F.col("_cell.value")).try_cast("double")
    return long.filter(F.abs(amount) >= SMALLEST_AMOUNT).select(
        *[_c(n) for n in names], F.col("_cell.day").alias("transaction_date"), _amount(F.col("_cell.value")).alias("revenue")
    )


def _amount(text: Column) -> Column:
    """Two decimals, halves away from zero; null for infinities."""
    return F.round(F.trim(text).try_cast("decimal(28,6)"), 2).cast("decimal(28,2)")


# ---- grids of any number of sheets in one plan ------------------------------------------------------------------


def sheet_plans(
    headers: DataFrame, decisions: DataFrame, first_year: int | None = None, last_year: int | None = None, fallback_year: int = 2024
) -> DataFrame:
    """One row per decided sheet telling, by column position, what to read from each of its rows.

    bindings: (field, positions); dates: (pos, day); plus which exclusions hold.
    """
    told = decisions.select("file", "sheet", "target_table", "column_mapping", "data_format", "exclude_rules", "id_columns")
    dated = headers.join(told, ["file", "sheet"]).withColumn("dated", date_positions(F.col("header"), first_year, last_year))
    staged = dated.withColumn("wide", F.coalesce(F.col("data_format").isin(*WIDE_FORMATS), F.size("dated") >= WIDE_FROM)).withColumn(
        "dates",
        F.when(F.col("wide"), F.when(F.size("dated") > 0, F.col("dated")).otherwise(month_positions(F.col("header"), fallback_year))),
    )
    usable = F.filter(
        F.map_entries("column_mapping"),
        lambda e: e["value"].isNotNull() & ~e["value"].isin("null", "") & F.array_contains("header", e["key"]),
    )
    at = F.transform(usable, lambda e: F.struct(e["value"].alias("field"), F.array_position("header", e["key"]).cast("int").alias("pos"), e["key"].alias("source")))
    date_at = F.transform("dates", lambda d: d["pos"])
    statics = F.sort_array(F.transform(
        F.filter(at, lambda e: ~F.array_contains(date_at, e["pos"]) & ~e["source"].startswith("Unnamed")),
        lambda e: F.struct(e["pos"].alias("pos"), e["field"].alias("field")),
    ))
    chosen = F.when(F.col("wide"), statics).otherwise(F.transform(at, lambda e: F.struct(e["pos"].alias("pos"), e["field"].alias("field"))))
    fields = F.array_distinct(F.transform("chosen", lambda e: e["field"]))
    bindings = F.transform(
        fields,
        lambda f: F.struct(f.alias("field"), F.transform(F.filter("chosen", lambda e: e["field"] == f), lambda e: e["pos"]).alias("positions")),
    )
    rules = F.transform("exclude_rules", lambda r: F.lower(r))
    id_at = F.filter(F.transform("id_columns", lambda c: F.array_position("header", c).cast("int")), lambda p: p > 0)
    return staged.withColumn("chosen", chosen).select(
        "file", "sheet",
        F.col("block").alias("header_block"), F.col("seq").alias("header_seq"),
        "target_table", "wide", "dates", bindings.alias("bindings"),
        F.coalesce(F.exists(rules, lambda r: r.contains("total")), F.lit(False)).alias("no_totals"),
        F.coalesce(F.exists(rules, lambda r: r.rlike("blank|empty|nan")), F.lit(False)).alias("no_blank_ids"),
        F.try_element_at(id_at, F.lit(1)).alias("id_pos"),
    )


def apply_mapping(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """Records (file, sheet, block, seq, part, target_table, values map) of all decided sheets.

    The only join brings a sheet's plan to its rows; everything after it happens inside a row. A large sheet is thus
    never gathered: the plans are broadcast when small, and a skewed sheet is split by adaptive execution.
    """
    joined = cells.join(plans, ["file", "sheet"])
    below = (F.col("block") > F.col("header_block")) | ((F.col("block") == F.col("header_block")) & (F.col("seq") > F.col("header_seq")))

    def cell(pos: Column) -> Column:
        return F.get("cells", pos - 1)

    total = F.exists("cells", lambda c: F.coalesce(F.lower(c).contains("total"), F.lit(False)))
    blank_id = F.coalesce(F.trim(cell(F.col("id_pos"))), F.lit("")) == ""
    kept = joined.filter(below & ~(F.col("no_totals") & total) & ~(F.col("no_blank_ids") & F.col("id_pos").isNotNull() & blank_id))
    last = F.transform(
        "bindings",
        lambda b: F.struct(
            b["field"].alias("field"),
            F.try_element_at(F.filter(F.transform(b["positions"], cell), lambda v: v.isNotNull()), F.lit(-1)).alias("value"),
        ),
    )
    valued = kept.withColumn("base", F.map_from_entries(F.filter(last, lambda e: e["value"].isNotNull())))
    where = ["file", "sheet", "block", "seq"]
    long = valued.filter(~F.col("wide") & (F.size("base") >= 2)).select(*where, F.lit(0).alias("part"), "target_table", F.col("base").alias("values"))

    amounts = F.filter(
        F.transform("dates", lambda d: F.struct(d["day"].alias("day"), cell(d["pos"]).alias("value"))),
        lambda a: F.coalesce(F.abs(F.trim(a["value"]).try_cast("double")) >= SMALLEST_AMOUNT, F.lit(False)),
    )
    wide = valued.filter(F.col("wide") & (F.size("base") >= 1)).select(*where, "target_table", "base", F.posexplode(amounts).alias("part", "a"))
    rest = F.map_filter("base", lambda k, v: ~k.isin("transaction_date", "revenue"))
    added = F.create_map(F.lit("transaction_date"), F.col("a.day").cast("string"), F.lit("revenue"), _amount(F.col("a.value")).cast("string"))
    return long.unionByName(wide.select(*where, "part", "target_table", F.map_concat(rest, added).alias("values")))


def table_records(records: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One target table's records as named text columns, after their position."""
    return records.filter(F.col("target_table") == table).select(
        "file", "sheet", "block", "seq", "part", *[F.try_element_at("values", F.lit(c)).alias(c) for c in columns]
    )


# ---- canonical shape ---------------------------------------------------------------------------------------------


def rename_to_canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename mapped columns; of several sources for one target the last with a value wins. Others stay."""
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(mapping.get(name, name), []).append(name)
    return df.select(*[F.coalesce(*[_c(n) for n in reversed(names)]).alias(target) for target, names in sources.items()])


def fill_required(df: DataFrame, table: Table) -> DataFrame:
    """Defaults into missing values; required columns that do not exist are added."""
    out = df
    for name, value in table.defaults.items():
        out = out.withColumn(name, F.coalesce(_c(name), F.lit(value)) if name in df.columns else F.lit(value))
    for name in ("client_id", *table.required):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(column_type(name)))
    return out


def split_required(df: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Rows with all required values, and the others."""
    complete = F.lit(True)
    for name in ("client_id", *table.required):
        complete = complete & _c(name).isNotNull()
    return df.filter(complete), df.filter(~complete)


def to_canonical(
    df: DataFrame, table: str | Table, mapping: Mapping[str, str], client_id: str, keep: Sequence[str] = (), keyed: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of one canonical table.

    Rename, derive a missing customer_id from the name, keep catalog columns, add the client, fill defaults, type
    dates, flags and numbers, and set rows without a required value aside. Columns in ``keep`` pass through as they are.
    Generated keys are unique within ``df``; a table made of several frames takes ``keyed=False`` and keys their union.
    """
    target = TABLES[table] if isinstance(table, str) else table
    out = rename_to_canonical(df, mapping)
    if "customer_id" in target.required:
        name = next((c for c in ("customer_name", "account_name", "company_name", "customer") if c in out.columns), None)
        # Made from names only when the table has no id at all, so that two kinds of ids never mix.
        if name and ("customer_id" not in out.columns or out.filter(blank_to_null("customer_id").isNotNull()).isEmpty()):
            out = out.withColumn("customer_id", customer_key(F.lit(client_id), _c(name)))
    columns = [c for c in target.columns if c in out.columns]
    if not columns:
        raise ValueError(f"no column of {target.name} among {df.columns}")
    kinds = {c: column_type(c).simpleString() for c in target.columns}
    typed = []
    for c in columns:
        kind = kinds[c]
        if kind == "date":
            value = parse_date(_c(c))
        elif kind == "boolean":
            value = parse_bool(_c(c))
        elif kind == "string":
            value = blank_to_null(_c(c))
        else:
            value = F.trim(_c(c).cast("string")).try_cast(kind)
        typed.append(value.alias(c))
    kept = [_c(c) for c in keep if c in out.columns and c not in target.columns]
    out = fill_required(out.select(F.lit(client_id).alias("client_id"), *typed, *kept), target)
    good, bad = split_required(out, target)
    every = target.columns

    def complete(part: DataFrame) -> DataFrame:
        return part.select("client_id", *[_c(c) if c in part.columns else F.lit(None).cast(kinds[c]).alias(c) for c in every], *kept)

    good = complete(good)
    if target.generated_key and keyed:
        from .keys import content_keys

        good = content_keys(good)
    return good, complete(bad)
