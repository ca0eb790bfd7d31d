"""Folder of spreadsheets -> keyed bronze tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import BENEFITS_NUMBERS, BRONZE_NUMBERS, bronze_columns
from ..functions.dates import parse_timestamp
from ..functions.text import blank_to_null
from ..operators import clean, date_order, headers, keys, reshape
from ..operators.classify import route
from ..session import materialise, staged
from ..sources import delimited, files, workbook
from ..sources.tables import union_records


@dataclass(frozen=True)
class BronzeOptions:
    """What differs between the families of clients."""

    benefits: bool = False
    first_year: int | None = None
    last_year: int | None = None
    fallback_year: int = 2024
    keys_per_table: bool = False

    @classmethod
    def for_benefits(cls) -> "BronzeOptions":
        return cls(benefits=True, fallback_year=2023)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Cells of all readable files below ``root``; only the kinds of file that occur are read."""
    present = {r[0] for r in files.discover(spark, root).select("extension").distinct().collect()}
    parts = [delimited.read_cells(spark, root, e) for e in ("csv", "tsv") if e in present]
    if "xlsx" in present:
        parts.append(workbook.read_cells(spark, root))
    if not parts:
        raise ValueError(f"no csv, tsv or xlsx below {root}")
    return union_records(parts)


def problems(spark: SparkSession, root: str) -> DataFrame:
    """(file, sheet, error) of the workbooks and sheets below ``root`` that ``read_folder`` could not read."""
    return workbook.problems(spark, root)


def extract(cells: DataFrame, decisions: DataFrame, options: BronzeOptions = BronzeOptions()) -> tuple[DataFrame, DataFrame]:
    """(records of all tables, decisions that matched no sheet).

    The cells are staged once, positions included, and both the search for headers and the records read that copy: a row's
    position is the same in both, however the files are split at either time. The summary of the sheets and the reading
    plans, one row per sheet, are materialised too.
    """
    cells = staged(cells, "cells")
    sheets = materialise(headers.sheet_summary(cells))
    every = headers.ALL_ENTITY_SHEETS
    group = decisions.filter(F.col("sheet") == every)
    # Group decisions only need their file resolved before they are expanded.
    probe = sheets.select("file").distinct().withColumn("sheet", F.lit(every))
    group_found, group_misses = files.resolve(group, probe)
    expanded = headers.expand_entity_sheets(group_found, sheets)
    found, misses = files.resolve(decisions.filter(F.col("sheet") != every), sheets)
    told = materialise(found.unionByName(expanded).withColumn("target_table", route(F.col("target_table"))))
    plans = materialise(reshape.sheet_plans(sheets, told, options.first_year, options.last_year, options.fallback_year))
    return reshape.apply_mapping(cells, plans), misses.unionByName(group_misses)


POSITION = ["file", "sheet", "block", "seq", "part"]


def bronze_table(records: DataFrame, table: str, prefix: str, client_name: str, options: BronzeOptions = BronzeOptions()) -> DataFrame:
    """One bronze table: typed columns, keys where the source has none, client name, and the row's position."""
    columns = bronze_columns(table, options.benefits)
    if not columns:
        raise ValueError(f"unknown table {table}")
    rows = reshape.table_records(records, table, columns)
    formats = keys.BENEFITS_FORMATS if options.benefits else keys.KEY_FORMATS
    numbers = {*BRONZE_NUMBERS, *(BENEFITS_NUMBERS if options.benefits else ())}
    days = [c for c in columns if "date" in c]
    # Files come from offices with customs of their own: the order of day and month is settled per file and column.
    rows = date_order.with_orders(rows, days, ["file"]) if days else rows
    typed = rows.select(*POSITION, *[
        parse_timestamp(F.col(c), order=F.col("_orders")[c]).alias(c) if "date" in c
        else F.trim(F.col(c)).try_cast("decimal(18,4)").alias(c) if c in numbers
        else blank_to_null(c).alias(c)
        for c in columns
    ])
    mark = F.lit(prefix)
    chunk = keys.row_position("file", "sheet", "block")

    def numbered(df: DataFrame, column: str, kind: str) -> DataFrame:
        """Missing keys are made up for the whole table at once; keys of the source win."""
        out = keys.sequence_keys(df, "_key", kind, mark, POSITION, chunk=chunk, formats=formats)
        return out.withColumn(column, F.coalesce(column, "_key")).drop("_key")

    transactions = ("transaction_fact", "monthly_financials") if options.benefits else ("transaction_fact",)
    if table in transactions:
        if "transaction_id" not in columns:
            typed = typed.withColumn("transaction_id", F.lit(None).cast("string"))
        typed = numbered(typed, "transaction_id", "TXN")
    elif table == "deal_opportunity":
        typed = numbered(typed, "deal_id", "DEAL")
    elif table == "contract":
        typed = numbered(typed, "contract_id", "CTR")
    elif table == "terminations_fact":
        typed = numbered(typed, "termination_id", "TERM")
    return typed.select(F.lit(client_name).alias("client_name_tag"), *[c for c in typed.columns])


def date_report(records: DataFrame, table: str, options: BronzeOptions = BronzeOptions()) -> DataFrame:
    """(file, column, counts, order, ambiguous) of a table's date columns: how each file's dates are read, and what is a guess."""
    columns = bronze_columns(table, options.benefits)
    return date_order.orders(reshape.table_records(records, table, columns), [c for c in columns if "date" in c], ["file"])


# Name column, key column and kind of the keys made from names.
DICTIONARIES = (
    ("customer_name", "customer_id", "CUST"), ("product_name", "product_sku", "SKU"),
    ("sales_rep_name", "sales_rep_id", "REP"), ("client_name", "client_id", "CLI"),
)


def name_keys(tables: dict[str, DataFrame], prefix: str, options: BronzeOptions = BronzeOptions()) -> dict[str, DataFrame]:
    """Add customer, product, representative and client keys; one numbering over all tables unless asked otherwise."""
    formats = keys.BENEFITS_FORMATS if options.benefits else keys.KEY_FORMATS
    out = dict(tables)
    for name, key, kind in DICTIONARIES:
        holders = {t: df for t, df in out.items() if name in df.columns and (kind != "CLI" or t == "book_of_business_fact")}
        if not holders:
            continue
        universe = union_records([df.select(name).distinct() for df in holders.values()])
        for table, df in holders.items():
            known = df.withColumnRenamed(key, "_known") if key in df.columns else df.withColumn("_known", F.lit(None).cast("string"))
            made = keys.dictionary_keys(known, name, key, kind, F.lit(prefix), universe=None if options.keys_per_table else universe, formats=formats)
            out[table] = made.withColumn(key, F.coalesce("_known", key)).drop("_known")
    return out


def build(
    records: DataFrame,
    names: list[str],
    prefix: str,
    client_name: str,
    options: BronzeOptions = BronzeOptions(),
    positions: bool = False,
) -> dict[str, DataFrame]:
    """All bronze tables of a client. The records are staged once, in a folder per table, so each table reads its own.

    ``positions`` adds a ``_position`` column with each row's place in its source, by which the silver layer knows the
    last of repeated rows.
    """
    records = staged(records, "records", ["target_table"])
    keyed = name_keys({t: bronze_table(records, t, prefix, client_name, options) for t in names}, prefix, options)
    place = [F.struct(*POSITION).alias(clean.POSITION)] if positions else []
    out = {}
    for table, df in keyed.items():
        data = [c for c in df.columns if c not in (*POSITION, "client_name_tag", "client_name")]
        # Tables that name their own clients keep those names.
        owner = F.col("client_name") if "client_name" in df.columns else F.col("client_name_tag").alias("client_name")
        out[table] = df.select(owner, *data, *place)
    return out
