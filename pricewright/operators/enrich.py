"""Repairs and derived columns of the silver layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import num
from ..functions.text import blank_to_null, real_name, strip
from .ordering import keep_last

# Words of each category, tried in this order; and the attributes a lookup may fill.
CATEGORY_WORDS = (
    ("revenue", ("revenue", "arr", "mrr", "sales", "income")),
    ("expense", ("cost", "cogs", "expense", "salary", "rent", "depreciation")),
    ("margin", ("margin", "profit", "ebitda", "net")),
)
ENRICHED = ("industry", "segment", "tier", "company_type")
REP_COLUMNS = ("sales_rep_name", "rep_name", "rep")


def flag_negative(df: DataFrame) -> DataFrame:
    """revenue_type: credit/adjustment below zero, otherwise what it was, or standard."""
    known = F.col("revenue_type") if "revenue_type" in df.columns else F.lit("standard")
    return df.withColumn("revenue_type", F.when(num("revenue") < 0, "credit/adjustment").otherwise(known))


def categorize(df: DataFrame, item: str = "line_item") -> DataFrame:
    """Category of a financial line by the first word list it meets; an existing category stays."""
    if "category" in df.columns:
        return df
    text = F.lower(F.coalesce(F.col(item).cast("string"), F.lit("")))
    out: Column | None = None
    for label, words in CATEGORY_WORDS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return df.withColumn("category", out.otherwise("uncategorized"))


def derive_discount(df: DataFrame) -> DataFrame:
    """discount_pct from list and invoice price where the list price is positive; an existing column stays."""
    if "discount_pct" in df.columns or not {"list_price", "invoice_price"} <= set(df.columns):
        return df
    listed, invoiced = num("list_price"), num("invoice_price")
    return df.withColumn("discount_pct", F.when(listed > 0, (listed - invoiced) / listed * 100))


def dedup_deals(df: DataFrame, order: Column, keys: Sequence[str] = ("customer_name", "opportunity_name")) -> DataFrame:
    """Last load per customer and opportunity."""
    return keep_last(df, keys, order) if set(keys) <= set(df.columns) else df


def dedup_reps(df: DataFrame, order: Column) -> DataFrame:
    """Last load per representative, by the first name column present."""
    name = next((c for c in REP_COLUMNS if c in df.columns), None)
    return df if name is None else keep_last(df, [name], order)


def distinct_names(tables: Sequence[DataFrame], column: str = "customer_name", keys: Sequence[str] = ()) -> DataFrame:
    """All real names of the tables that carry the column."""
    parts = [t.select(*keys, real_name(column).alias(column)).filter(F.col(column).isNotNull()).distinct() for t in tables if column in t.columns]
    if not parts:
        raise ValueError(f"no table has {column}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def apply_merges(df: DataFrame, merges: DataFrame, column: str = "customer_name", keys: Sequence[str] = ()) -> DataFrame:
    """Replace names by their canonical form; ``merges`` has (``keys``..., name, canonical), unique per name.

    Spark picks the join: the map is broadcast when its measured size allows, otherwise a frequent name is split.
    """
    lookup = merges.select(*keys, F.col("name").alias("_name"), F.col("canonical").alias("_canonical"))
    named = df.withColumn("_name", strip(column))
    out = named.join(lookup, [*keys, "_name"], "left")
    return out.withColumn(column, F.coalesce("_canonical", "_name")).select(*df.columns)


def merge_counts(before: DataFrame, after: DataFrame, table: str, column: str = "customer_name") -> DataFrame:
    """Log row with the number of names before and after merging, when it changed."""
    a = before.select(column).distinct().agg(F.count(column).alias("a")).withColumn("_one", F.lit(1))
    b = after.select(column).distinct().agg(F.count(column).alias("b")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").filter(F.col("a") != F.col("b")).select(
        F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit("entity_merge").alias("action"),
        (F.col("a") - F.col("b")).alias("affected"),
        F.format_string("merged %d into %d names", "a", "b").alias("detail"),
    )


def enrich(df: DataFrame, lookup: DataFrame, name: str = "customer_name", fields: Sequence[str] = ENRICHED) -> DataFrame:
    """Fill missing attributes from a lookup by name; values present are never replaced.

    Of several lookup rows of one name the fullest counts, of equally full ones the first by value.
    """
    extra = lookup.select(F.col(name), *[blank_to_null(f).alias(f"_new_{f}") for f in fields if f in lookup.columns])
    new = [c for c in extra.columns if c != name]
    if new:
        known = sum((F.col(c).isNotNull().cast("int") for c in new[1:]), F.col(new[0]).isNotNull().cast("int"))
        extra = extra.groupBy(name).agg(F.min(F.struct((-known).alias("_order"), *new)).alias("_e")).select(name, *[f"_e.{c}" for c in new])
    else:
        extra = extra.distinct()
    out = df.join(extra, name, "left")
    for f in fields:
        new = F.col(f"_new_{f}") if f in lookup.columns else F.lit(None).cast("string")
        out = out.withColumn(f, F.coalesce(F.col(f), new) if f in df.columns else new)
    return out.select(*df.columns, *[f for f in fields if f not in df.columns])
