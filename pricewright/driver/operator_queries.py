"""Registered ingestion, cleaning, key, mapping and quality operators over whole driver tables, with their SQL.

The driver's tables are clean, so each query first writes its column the way messy sources do (serial dates, mixed
spellings, repeated rows) and then repairs it; the SQL states the expected outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import BENEFITS_ROUTES, TABLES
from ..functions import dates, numeric, text
from ..operators import asof, classify, clean, content, context, date_order, enrich, entities, headers, keys, profile, quality, reshape, similar_names, sketches
from ..plans import bronze, filters
from ..sources import files
from ..sources.tables import merge_into
from .bindings import Bindings
from .oracle import pct, statement
from .registry import Query, plain

QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None):
    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: plain(fn(Bindings(spark, folder)))
        if sql:
            _SQL[name] = sql
        return fn
    return add


def key_case(*pairs, other):
    """CASE on the order key: (divisor, remainder, value)..."""
    out = None
    for divisor, rest, value in pairs:
        hit = F.col("o_orderkey") % divisor == rest
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(other)


def raw_orders(b: Bindings, *more) -> DataFrame:
    """Orders as a spreadsheet export would hold them: everything is text. ``more`` are further columns."""
    day = F.col("o_orderdate").cast("date")
    return b.raw("orders").select(
        "o_orderkey",
        key_case(
            (5, 0, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")),
            (5, 1, F.date_format(day, "yyyy-MM-dd")),
            (5, 2, F.date_format(day, "M/d/yyyy")),
            (5, 3, F.lit("1970-01-01")),
            other=F.lit("unknown"),
        ).alias("order_date"),
        key_case((6, 0, F.lit("n.a.")), (6, 1, F.lit(None).cast("string")), other=F.col("o_custkey").cast("string")).alias("order_amount"),
        key_case((4, 0, F.lit("  nan ")), (4, 1, F.lit("")), (4, 2, F.concat(F.lit(" "), "o_orderpriority")), other=F.col("o_orderpriority")).alias("note"),
        key_case((7, 0, F.lit("TRUE")), (7, 1, F.lit("1")), (7, 2, F.lit("Yes")), (7, 3, F.lit("false")), (7, 4, F.lit("0")), (7, 5, F.lit("NO")), other=F.lit("maybe")).alias("promotional_flag"),
        F.col("o_orderstatus").alias("price_tier"), *more,
    )


def day_first(other=None):
    """The order's day as a European sheet writes it, on three of five rows."""
    day = F.col("o_orderdate").cast("date")
    return key_case((5, 0, F.date_format(day, "d/M/yyyy")), (5, 1, F.date_format(day, "d.M.yyyy")), (5, 2, F.date_format(day, "dd-MM-yyyy HH:mm")), other=F.lit(other).cast("string"))


_DAY = """CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 = 3 THEN DATE '1970-01-01' END"""


@register(f"""SELECT o_orderkey, CAST({_DAY} AS VARCHAR) AS order_date,
    CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS due_date FROM orders""")
def serial_dates(b):
    both = date_order.with_orders(raw_orders(b, day_first().alias("due_date")), ["order_date", "due_date"], [])
    return both.select("o_orderkey", *[dates.parse_date(c, order=F.col("_orders")[c]).alias(c) for c in ("order_date", "due_date")])


@register("""
WITH written AS (
    SELECT o_orderpriority AS file, o_orderkey % 5 AS k, day(CAST(o_orderdate AS DATE)) AS d, month(CAST(o_orderdate AS DATE)) AS m FROM orders WHERE o_orderkey % 5 < 3),
counts AS (
    SELECT file, c AS "column", CASE WHEN c = 'order_date' OR k = 0 THEN '/' WHEN k = 1 THEN '.' ELSE '-' END AS separator, d > 12 AS sole, c = 'due_date' AS by_day
    FROM written, (VALUES ('order_date'), ('due_date')) t(c) WHERE c = 'due_date' OR k = 2)
SELECT file, "column", separator, count(*) FILTER (sole AND NOT by_day) AS month_only, count(*) FILTER (sole AND by_day) AS day_only,
    count(*) FILTER (NOT sole) AS either,
    CASE WHEN max(CASE WHEN by_day THEN 1 ELSE 0 END) = 1 THEN 'day' ELSE 'month' END AS "order"
FROM counts GROUP BY file, "column", separator""")
def date_orders(b):
    rows = raw_orders(b, day_first("no date").alias("due_date"), F.col("o_orderpriority").alias("file"))
    columns = ["order_date", "due_date"]
    told = date_order.orders(rows, columns, ["file"]).select("file", "column", "order")
    return date_order.evidence(rows, columns, ["file"]).join(told, ["file", "column"])


@register("SELECT count(*) FILTER (o_orderkey % 5 = 3) AS flagged, count(*) AS rows FROM orders")
def epoch_flag(b):
    return raw_orders(b).agg(F.count_if(F.year(dates.parse_timestamp("order_date")) == 1970).alias("flagged"), F.count(F.lit(1)).alias("rows"))


@register("SELECT count(*) FILTER (o_orderkey % 6 <> 1) AS before, count(*) FILTER (o_orderkey % 6 > 1) AS after, count(*) FILTER (o_orderkey % 6 = 0) AS lost FROM orders")
def coerce_loss(b):
    before, after = F.count("order_amount"), F.count(clean.as_number(F.col("order_amount")))
    return raw_orders(b).agg(before.alias("before"), after.alias("after"), (before - after).alias("lost"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 2 THEN o_orderpriority END AS note FROM orders")
def null_tokens(b):
    return raw_orders(b).select("o_orderkey", text.blank_to_null("note").alias("note"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN true WHEN o_orderkey % 7 < 6 THEN false END AS flag FROM orders")
def bool_parse(b):
    return raw_orders(b).select("o_orderkey", text.parse_bool("promotional_flag").alias("flag"))


@register("""SELECT DISTINCT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)""")
def dedup_exact(b):
    lines = b.raw("lineitem")
    return clean.clean(lines.unionByName(lines.filter("l_linenumber = 1")), "lines", {})[0]


@register("""
SELECT order_date, order_amount, note, promotional_flag, price_tier FROM (SELECT DISTINCT
    CAST(CAST(CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 = 3 THEN DATE '1970-01-01' END AS TIMESTAMP) AS VARCHAR) AS order_date,
    CASE WHEN o_orderkey % 6 > 1 THEN CAST(o_custkey AS DOUBLE) END AS order_amount,
    CASE WHEN o_orderkey % 4 >= 2 THEN o_orderpriority END AS note, o_orderkey % 4 AS spelling,
    CASE WHEN o_orderkey % 7 < 3 THEN true WHEN o_orderkey % 7 < 6 THEN false END AS promotional_flag, o_orderkey % 7 AS flag_spelling,
    o_orderstatus AS price_tier FROM orders)""")
def clean_table(b):
    return clean.clean(raw_orders(b).drop("o_orderkey"), "orders")[0]


@register("""
SELECT 'orders' AS "table", c AS "column", a AS action, n AS affected FROM (
    SELECT 'order_date' AS c, 'convert_serial_dates' AS a, count(*) FILTER (o_orderkey % 5 = 0) AS n FROM orders
    UNION ALL SELECT 'order_date', 'flag_1970_dates', count(*) FILTER (o_orderkey % 5 = 3) FROM orders
    UNION ALL SELECT 'order_date', 'coerce_dates', count(*) FILTER (o_orderkey % 5 = 4) FROM orders
    UNION ALL SELECT 'due_date', 'coerce_dates', count(*) FILTER (o_orderkey % 5 > 2) FROM orders
    UNION ALL SELECT 'order_amount', 'coerce_numeric', count(*) FILTER (o_orderkey % 6 = 0) FROM orders
    UNION ALL SELECT NULL, 'drop_duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT
        CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 = 3 THEN DATE '1970-01-01' END,
        CASE WHEN o_orderkey % 6 > 1 THEN o_custkey END, CASE WHEN o_orderkey % 4 >= 2 THEN o_orderpriority END, o_orderkey % 4,
        o_orderkey % 7, o_orderstatus FROM orders)) FROM orders) WHERE n > 0""")
def cleaning_log(b):
    return clean.clean(raw_orders(b, day_first("later").alias("due_date")).drop("o_orderkey"), "orders")[1].drop("detail")


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@register(f"SELECT p_partkey, {_SLUG.format(chr(39) + ' ' + chr(39) + ' || p_brand || ' + chr(39) + ' & ' + chr(39) + ' || p_name')} AS slug FROM part")
def slugify(b):
    return b.raw("part").select("p_partkey", text.slug(F.concat(F.lit(" "), "p_brand", F.lit(" & "), "p_name")).alias("slug"))


@register(f"""SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN substr(r_name, 1, 6) || '-' || substr(s, 1, 40)
    || CASE WHEN length(s) > 40 THEN '-' || substr(sha256(s), 1, 12) ELSE '' END END AS customer_id
    FROM (SELECT *, {_SLUG.format("(CASE WHEN c_custkey % 2 = 0 THEN 'International Business Holdings Corporation ' ELSE '' END || c_name)")} AS s FROM home)""")
def derive_customer_id(b):
    long = F.when(F.col("c_custkey") % 2 == 0, "International Business Holdings Corporation ").otherwise("")
    name = F.when(F.col("c_custkey") % 9 > 0, F.concat(long, F.col("c_name"))).otherwise("  ")
    return b.home.select("c_custkey", text.customer_key("r_name", name).alias("customer_id"))


@register("""SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || substr(split_part(p_name, ' ', 2), 1, 1) || '.' AS short,
    upper(substr(split_part(p_name, ' ', 1), 1, 2)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) AS prefix FROM part""")
def names_and_prefixes(b):
    return b.raw("part").select("p_partkey", text.short_name("p_name").alias("short"), text.client_prefix("p_name").alias("prefix"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '$' || CAST(o_orderkey % 1000 AS VARCHAR)
    WHEN o_orderkey % 3 = 1 THEN '$' || CAST(o_orderkey % 999 + 1 AS VARCHAR) || 'K' ELSE '$' || CAST(o_orderkey % 99 + 1 AS VARCHAR) || '.5M' END AS label FROM orders""")
def display_labels(b):
    key = F.col("o_orderkey")
    value = F.when(key % 3 == 0, key % 1000).when(key % 3 == 1, (key % 999 + 1) * 1000).otherwise((key % 99 + 1) * 1000000 + 500000)
    return b.raw("orders").select("o_orderkey", text.money_label(value).alias("label"))


# ---- reshaping ---------------------------------------------------------------------------------------------------


def labelled_orders(b):
    return b.raw("orders").select(
        "o_orderkey",
        key_case((7, 0, F.concat(F.lit("Sub-Total "), "o_orderpriority")), (7, 1, F.lit("  ")), (7, 2, F.lit(None).cast("string")), other=F.col("o_orderpriority")).alias("label"),
        key_case((11, 0, F.lit("TOTALS")), other=F.col("o_orderstatus")).alias("status"),
    )


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN '  ' WHEN o_orderkey % 7 <> 2 THEN o_orderpriority END AS label, o_orderstatus AS status
    FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def exclude_totals(b):
    return reshape.exclude_totals(labelled_orders(b))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Sub-Total ' ELSE '' END || o_orderpriority AS label,
    CASE WHEN o_orderkey % 11 = 0 THEN 'TOTALS' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 NOT IN (1, 2)""")
def exclude_blank_ids(b):
    return reshape.exclude_blank_ids(labelled_orders(b), ["absent", "label", "status"])


@register("""SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey WHEN o_orderkey % 2 = 0 THEN o_custkey END AS revenue, o_orderstatus AS region
    FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey % 3 > 0 OR o_orderkey % 2 = 0""")
def long_project(b):
    raw = b.raw("orders").select(
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("Customer"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("Amount"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("Amount_1"),
        F.col("o_orderstatus").alias("Status"),
    )
    return reshape.long_project(raw, {"Customer": "customer_id", "Amount": "revenue", "Amount_1": "revenue", "Status": "region", "Gone": "channel"})


_MONTHS = ["2024-01-01", "2024-02-01", "2024-03-01"]


@register("""SELECT customer_id, product_name, m AS transaction_date, CAST(v AS DOUBLE) / 100 AS revenue FROM (
    SELECT o_custkey AS customer_id, o_orderpriority AS product_name, '2024-01-01' AS m, -o_orderkey AS v FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey > 0
    UNION ALL SELECT o_custkey, o_orderpriority, '2024-02-01', o_custkey * 100 FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey > 0
    UNION ALL SELECT o_custkey, o_orderpriority, '2024-03-01', 1 FROM orders WHERE o_orderkey % 2 = 0)""")
def wide_unpivot(b):
    key = F.col("o_orderkey")
    raw = b.raw("orders").select(
        F.col("o_custkey").alias("Customer"),
        F.col("o_orderpriority").alias("Product"),
        F.when(key % 3 > 0, (-key / 100).cast("decimal(18,2)").cast("string")).otherwise("n/a").alias(_MONTHS[0]),
        F.when(key % 4 == 0, F.col("o_custkey").cast("string")).alias(_MONTHS[1]),
        F.when(key % 2 == 0, "0.01").otherwise("0.005").alias(_MONTHS[2]),
    )
    out = reshape.wide_unpivot(raw, {"Customer": "customer_id", "Product": "product_name"}, {m: m for m in _MONTHS})
    return out.withColumn("revenue", numeric.num("revenue"))


def order_sheets(b) -> DataFrame:
    """Orders as delimited grids, one file per status, with a header row first."""
    orders = b.raw("orders")
    line = orders.select(
        F.concat(F.lit("in/orders_"), "o_orderstatus", F.lit(".csv")).alias("file"),
        (F.col("o_orderkey") + 1).alias("seq"),
        F.array(
            F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey").cast("string")),
            F.when(F.col("o_orderkey") % 13 == 0, "Total").otherwise(F.col("o_orderpriority")),
            F.col("o_orderkey").cast("string"),
            F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") + 1).cast("string")),
            F.lit("x"),
        ).alias("cells"),
    )
    wide = F.col("file").contains("_P")
    head = line.select("file").distinct().select(
        "file", F.lit(0).cast("long").alias("seq"),
        F.when(wide, F.array(*[F.lit(x) for x in ("Customer", "Product", "2024-01-01", "2024-02-01", "Jan 2031")]))
        .otherwise(F.array(*[F.lit(x) for x in ("Customer", "Product", "Amount", "Amount", "Notes")])).alias("cells"),
    )
    return head.unionByName(line).select(
        "file", F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_index"), F.lit(0).cast("long").alias("block"), "seq", "cells",
        F.transform("cells", lambda c: c.isNotNull()).alias("is_text"),
    )


def order_decisions(b) -> DataFrame:
    names = b.raw("orders").select(F.concat(F.lit("orders_"), "o_orderstatus", F.lit(".csv")).alias("file")).distinct()
    mapping = {"Customer": "customer_id", "Product": "product_name", "Amount": "revenue", "Amount_1": "revenue"}
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return names.select(
        "file", F.lit("any").alias("sheet"), F.lit("transaction_fact").alias("target_table"), entries.alias("column_mapping"),
        F.when(F.col("file").contains("_P"), "wide_dates").otherwise("long").alias("data_format"),
        F.array(F.lit("Exclude TOTAL rows")).alias("exclude_rules"), F.array(F.lit("Customer")).alias("id_columns"),
    )


@register("""
SELECT seq, file, transaction_date, customer_id, product_name, revenue FROM (
    SELECT o_orderkey + 1 AS seq, 'in/orders_' || o_orderstatus || '.csv' AS file, CAST(NULL AS VARCHAR) AS transaction_date,
        CAST(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS DOUBLE) AS customer_id, o_orderpriority AS product_name,
        CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS DOUBLE) AS revenue
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 13 <> 0
    UNION ALL SELECT o_orderkey + 1, 'in/orders_P.csv', '2024-01-01', CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END, o_orderpriority, o_orderkey
    FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 13 <> 0 AND o_orderkey > 0
    UNION ALL SELECT o_orderkey + 1, 'in/orders_P.csv', '2024-02-01', CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END, o_orderpriority, o_orderkey + 1
    FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 13 <> 0 AND o_orderkey % 2 = 0)""")
def sheet_records(b):
    records, _ = bronze.extract(order_sheets(b), order_decisions(b))
    return reshape.table_records(records, "transaction_fact", ["transaction_date", "customer_id", "product_name", "revenue"]).select(
        "seq", "file", "transaction_date", F.col("customer_id").cast("double"), "product_name", F.col("revenue").cast("double")
    )


def customer_books(b) -> DataFrame:
    """Orders as workbook rows: one file per customer, rows by order key."""
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    key = F.col("o_orderkey")
    return b.raw("orders").select(
        F.concat(F.lit("book_"), F.col("o_custkey").cast("string"), F.lit(".xlsx")).alias("file"), F.lit("S").alias("sheet"),
        F.lit(0).cast("long").alias("block"), row.cast("long").alias("seq"),
        F.array(F.col("o_orderpriority"), F.when(key % 2 == 0, "text").otherwise("no"), F.when(key % 3 == 0, key.cast("string")).otherwise("words")).alias("cells"),
        F.array(F.lit(True), F.lit(True), key % 3 != 0).alias("is_text"),
    )


@register("""
SELECT 'book_' || o_custkey || '.xlsx' AS file, arg_min(r, -score * 1000000 + r) AS seq, max(n) AS rows,
    arg_min(o_orderpriority || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'no' END || '|' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'words' END,
        -score * 1000000 + r) AS header
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n,
        1 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 <> 0)::INT AS score FROM orders) WHERE r < 15 GROUP BY o_custkey""")
def header_detection(b):
    found = headers.sheet_summary(customer_books(b))
    return found.select("file", "seq", "rows", F.array_join("header", "|").alias("header"))


@register("""SELECT p_partkey, p_brand || '|' || p_type || '|' || p_brand || '_1|Unnamed: 3|' || p_brand || '_2|' || p_type || '_1' AS header FROM part""")
def column_cleanup(b):
    raw = F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.col("p_brand"), F.lit("  "), F.concat("p_brand", F.lit(" ")), F.col("p_type"))
    return b.raw("part").select("p_partkey", F.array_join(headers.header_names(raw), "|").alias("header"))


def order_books(b) -> DataFrame:
    """Workbooks whose sheets are a customer's orders."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    key = F.col("o_orderkey")
    return b.raw("orders").select(
        F.col("o_custkey").cast("string").alias("file"),
        F.concat(F.when(key % 4 == 0, "Summary ").when(key % 4 == 1, "top 10 of ").otherwise("Dealer "), key.cast("string")).alias("sheet"),
        place.alias("sheet_index"),
    )


_BOOKS = """SELECT CAST(o_custkey AS VARCHAR) AS file, CASE o_orderkey % 4 WHEN 0 THEN 'Summary ' WHEN 1 THEN 'top 10 of ' ELSE 'Dealer ' END || o_orderkey AS sheet,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey FROM orders"""


@register(f"""
SELECT file, sheet, CAST(i AS INTEGER) AS sheet_index FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank, i) AS place FROM (
    SELECT *, CASE WHEN n <= 8 OR i < 4 OR i >= n - 2 THEN 0 WHEN (i - 4) % greatest(1, n // 2) = 0 THEN 1 END AS rank FROM ({_BOOKS})) WHERE rank IS NOT NULL)
WHERE place <= 8""")
def sheet_sample(b):
    return headers.sample_sheets(order_books(b), 8)


@register(f"""
SELECT file, sheet FROM ({_BOOKS}) WHERE o_orderkey % 4 > 1""")
def entity_sheets(b):
    books = order_books(b)
    told = books.select("file").distinct().withColumn("sheet", F.lit(headers.ALL_ENTITY_SHEETS))
    return headers.expand_entity_sheets(told, books)


@register("""
SELECT 'x' || c_custkey AS id, r_name AS client_id, c_name AS intermediary_name, CASE WHEN c_custkey % 4 = 0 THEN 'distributor' ELSE 'broker' END AS intermediary_type
FROM home WHERE c_custkey % 5 > 0""")
def required_defaults(b):
    raw = b.home.select(
        F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("intermediary_id"), F.col("r_name").alias("client_id"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("intermediary_name"),
        F.when(F.col("c_custkey") % 4 > 0, "broker").alias("intermediary_type"),
    )
    table = TABLES["dim_intermediary"]
    good, _ = reshape.split_required(reshape.fill_required(raw, table), table)
    return good.withColumnRenamed("intermediary_id", "id")


@register("""SELECT 'promo-' || p_partkey AS promotion_id, 'client-x' AS client_id, 'cut' AS promotion_type, CAST(p_partkey AS VARCHAR) AS product_sku,
    CAST(DATE '2020-01-01' + CAST(p_partkey % 300 AS INTEGER) AS VARCHAR) AS promotion_start_date, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS DOUBLE) END AS regular_price
    FROM part WHERE p_partkey % 7 > 0""")
def canonical_shape(b):
    key = F.col("p_partkey")
    raw = b.raw("part").select(
        F.when(key % 7 > 0, F.concat(F.lit(" promo-"), key.cast("string"))).alias("Promo"), F.lit("cut").alias("promotion_type"), key.cast("string").alias("SKU"),
        (F.datediff(F.lit("2020-01-01").cast("date"), F.lit("1899-12-30").cast("date")) + key % 300).cast("string").alias("Start"),
        F.when(key % 3 > 0, key.cast("string")).otherwise("tbd").alias("Price"), F.col("p_name").alias("Unused"),
    )
    mapping = {"Promo": "promotion_id", "SKU": "product_sku", "Start": "promotion_start_date", "Price": "regular_price"}
    good, _ = reshape.to_canonical(raw, "dim_promotion", mapping, "client-x")
    return good.select("promotion_id", "client_id", "promotion_type", "product_sku", "promotion_start_date", numeric.num("regular_price").alias("regular_price"))


# ---- keys, classification, mapping -------------------------------------------------------------------------------


@register("""SELECT deal_id, client_id, 'ACE-DEAL-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS key
    FROM (SELECT deal_id, client_id, row_number() OVER (PARTITION BY client_id ORDER BY deal_close_date, CAST(deal_id AS BIGINT)) AS n FROM deals)""")
def sequence_keys(b):
    rows = b.fact_deal_opportunity.select("deal_id", "client_id", "deal_close_date", F.col("deal_id").cast("long").alias("n"))
    return keys.sequence_keys(rows, "key", "DEAL", F.lit("ACE"), ["deal_close_date", "n"], keys=["client_id"]).select("deal_id", "client_id", "key")


@register("""SELECT o_orderkey, 'ACE-TXN-' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS key
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""")
def row_keys(b):
    rows = b.raw("orders").select("o_orderkey")
    chunk = keys.row_position(sequence="o_orderkey")
    return keys.sequence_keys(rows, "key", "TXN", F.lit("ACE"), ["o_orderkey"], chunk=chunk)


@register("""SELECT c_custkey, client_id, CASE WHEN k = '' THEN '' ELSE 'ACE-CUST-' || lpad(CAST(r AS VARCHAR), 4, '0') END AS key FROM (
    SELECT c_custkey, r_name AS client_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment || ' ' || (c_custkey % 97) END AS k,
        dense_rank() OVER (PARTITION BY r_name, c_custkey % 10 = 0 ORDER BY c_mktsegment || ' ' || (c_custkey % 97)) AS r FROM home)""")
def dictionary_keys(b):
    name = F.when(F.col("c_custkey") % 10 == 0, "NaN").otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 97).cast("string"), F.lit(" ")))
    rows = b.home.select("c_custkey", F.col("r_name").alias("client_id"), name.alias("customer_name"))
    return keys.dictionary_keys(rows, "customer_name", "key", "CUST", F.lit("ACE"), keys=["client_id"]).drop("customer_name")


# The content is spelled as JSON with two-decimal amounts and ISO dates on both sides.
_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(f"""
SELECT l_orderkey, l_linenumber, sha256(sha256(content) || '#' || row_number() OVER (PARTITION BY content)) AS id FROM (
    SELECT l_orderkey, l_linenumber, '{{' || concat_ws(',', {', '.join(
        f"'\"{c}\":' || " + (f"'\"' || CAST({c} AS VARCHAR) || '\"'" if c in ('l_returnflag', 'l_linestatus', 'l_shipdate') else f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if c in _AMOUNTS else f"CAST({c} AS VARCHAR)")
        for c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', *_AMOUNTS, 'l_returnflag', 'l_linestatus', 'l_shipdate'))}) || '}}' AS content
    FROM (SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem UNION ALL SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem WHERE l_linenumber = 1))""")
def content_keys(b):
    lines = b.raw("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.col(c).cast("decimal(18,2)").alias(c) for c in _AMOUNTS],
        "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("l_shipdate"),
    )
    return keys.content_keys(lines.unionByName(lines.filter("l_linenumber = 1"))).select("l_orderkey", "l_linenumber", "id")


def _stems(b) -> DataFrame:
    # Subjects met in file names; each part gives one name.
    subjects = ("sales invoice", "deal pipeline", "master customer list", "price history", "vendor file", "rep quota", "carrier notes", "misc",
                "arr report", "cost to serve", "promo calendar", "market price survey", "rebate accruals", "product catalog", "agreement terms")
    pick = F.element_at(F.array(*[F.lit(s) for s in subjects]), (F.col("p_partkey") % len(subjects) + 1).cast("int"))
    return b.raw("part").select(F.concat("p_brand", F.lit(" "), pick, F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), pick.alias("subject"))


_EXPECTED = {
    "sales invoice": ("fact_revenue", "fact_revenue"), "deal pipeline": ("fact_deal_opportunity", "fact_deal_opportunity"),
    "master customer list": ("dim_customer", "dim_customer"), "price history": ("fact_list_price_history", "fact_list_price_history"),
    "vendor file": ("dim_vendor_platform", "dim_vendor_platform"), "rep quota": ("dim_sales_rep", "dim_sales_rep"),
    "carrier notes": (None, "fact_recurring_revenue"), "misc": (None, None), "arr report": ("fact_recurring_revenue", "dim_sales_rep"),
    "cost to serve": ("fact_cost_to_serve", "fact_cost_to_serve"), "promo calendar": ("dim_promotion", "dim_promotion"),
    "market price survey": ("fact_competitive_intel", "fact_competitive_intel"), "rebate accruals": ("fact_rebate_incentive", "fact_rebate_incentive"),
    "product catalog": ("dim_product", "dim_product"), "agreement terms": ("dim_contract", "dim_contract"),
}


def _expected_sql() -> str:
    names = list(_EXPECTED)
    cell = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    whole = " ".join(f"WHEN {i} THEN {cell(_EXPECTED[n][0])}" for i, n in enumerate(names))
    part = " ".join(f"WHEN {i} THEN {cell(_EXPECTED[n][1])}" for i, n in enumerate(names))
    subject = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    k = f"p_partkey % {len(names)}"
    return (f"SELECT p_brand || ' ' || CASE {k} {subject} END || ' ' || p_partkey AS name, CASE {k} {whole} END AS whole_words, "
            f"CASE {k} {part} END AS any_text FROM part")


@register(_expected_sql())
def classify_tables(b):
    name = F.col("name")
    return _stems(b).select("name", classify.classify_name(name).alias("whole_words"), classify.classify_name(name, whole_words=False).alias("any_text"))


_HEADERS = {"Txn ID": "transaction_id", "INVOICE-DATE": "transaction_date", " sku ": "product_sku", "Net Revenue": "revenue", "Selling Price": "invoice_price",
            "msrp": "list_price", "Amt USD": None, "quantity": "quantity", "Discount": None, "Rep ID": "sales_rep_id", "id": "customer_id"}


def _header_rows(b) -> DataFrame:
    names = F.array(*[F.lit(h) for h in _HEADERS])
    return b.raw("part").select(
        F.col("p_partkey").cast("string").alias("source"), F.lit("fact_revenue").alias("target_table"), F.explode(names).alias("column")
    )


_HEADER_VALUES = ", ".join(f"('{h}', {'CAST(NULL AS VARCHAR)' if c is None else chr(39) + c + chr(39)})" for h, c in _HEADERS.items())


@register(f"""SELECT CAST(p_partkey AS VARCHAR) AS source, 'fact_revenue' AS target_table, c AS "column", m AS canonical FROM part, (VALUES {_HEADER_VALUES}) t(c, m)""")
def map_columns(b):
    return classify.map_columns(_header_rows(b))


@register(f"""SELECT CAST(p_partkey AS VARCHAR) AS source, 'fact_revenue' AS target_table, c AS "column",
    CASE WHEN c = 'Amt USD' AND p_partkey % 2 = 0 THEN 'exchange_rate' ELSE m END AS canonical FROM part, (VALUES {_HEADER_VALUES}) t(c, m)""")
def column_decisions(b):
    told = _header_rows(b).filter(F.col("column").isin("Amt USD", "msrp", "Discount")).withColumn(
        "canonical",
        F.when(F.col("column") == "Discount", "discount_pct").when(F.col("column") == "msrp", "currency")
        .when(F.col("source").cast("int") % 2 == 0, "exchange_rate").otherwise("nowhere"),
    )
    return classify.apply_decisions(classify.map_columns(_header_rows(b)), told)


# Columns of the orders whose headers say nothing, as files of one office name them, and what they hold.
_UNNAMED = {"f1": ("o_custkey", "customer_id"), "f2": ("o_orderpriority", "loss_reason"), "f3": ("o_orderstatus", "deal_outcome"), "f4": ("CAST(date_trunc('month', o_orderdate) AS DATE)", "deal_close_date"),
            "f5": ("'Rep ' || CAST(o_custkey % 20 AS STRING)", "sales_rep_id"), "f6": ("o_orderkey", "deal_id")}


def _order_cells(b, keep, source, names: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c if names == 0 else v[1]).alias("column"), F.expr(v[0]).cast("string").alias("value")) for c, v in _UNNAMED.items()])
    return b.raw("orders").where(keep).select(source.alias("source"), F.lit("fact_deal_opportunity").alias("target_table"), F.explode(cells).alias("c")).select("source", "target_table", "c.*")


@register("""SELECT 'file ' || (o_orderkey % 3) AS source, 'fact_deal_opportunity' AS target_table, c AS "column", m AS canonical
    FROM (SELECT DISTINCT o_orderkey % 3 AS o_orderkey FROM orders),
    (VALUES ('f1', 'customer_id'), ('f2', 'loss_reason'), ('f3', 'deal_outcome'), ('f4', 'deal_close_date'), ('f5', 'sales_rep_id'), ('f6', NULL), ('Opp ID', 'deal_id')) t(c, m)""")
def content_mapping(b):
    """Files with meaningless headers, mapped by earlier loads of the same columns; order numbers are new in every load and stay open."""
    key = F.col("o_orderkey")
    new = _order_cells(b, key % 2 == 0, F.concat(F.lit("file "), (key % 3).cast("string")), 0)
    old = _order_cells(b, key % 2 == 1, F.concat(F.lit("old "), (key % 5).cast("string")), 1).withColumnRenamed("column", "canonical")
    known = content.merge(content.sketch(old, ["source", "target_table", "canonical"]), ["target_table", "canonical"])
    found = content.map_by_content(content.sketch(new, ["source", "target_table", "column"]), known)
    sources = new.select("source", "target_table").distinct()
    headers_ = sources.select("source", "target_table", F.explode(F.array(*[F.lit(c) for c in (*_UNNAMED, "Opp ID")])).alias("column"))
    return content.fill_mapping(classify.map_columns(headers_), found)


def _asked(b) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    number = F.format_string("%08d", key)
    real = b.raw("customer").select(F.concat(F.lit("dir/client_"), number, F.lit(".xlsx")).alias("file"), F.array(F.lit("Data"), F.lit("data")).alias("s")).select("file", F.explode("s").alias("sheet"))
    asked = b.raw("customer").select(
        F.when(key % 4 == 0, F.concat(F.lit("client_"), number, F.lit(".xlsx"))).when(key % 4 == 1, F.concat(F.lit("dir/client_"), number, F.lit(".xlsx")))
        .when(key % 4 == 2, F.concat(F.lit("_"), number)).otherwise(F.concat(F.lit("gone_"), number)).alias("file"),
        F.when(key % 3 == 0, "DATA").when(key % 3 == 1, "data").otherwise("Other").alias("sheet"),
        key.alias("k"),
    )
    return asked, real


@register("""SELECT CASE WHEN c_custkey % 4 < 3 AND c_custkey % 3 < 2 THEN 'dir/client_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.xlsx' END AS file,
    CASE WHEN c_custkey % 4 < 3 THEN CASE c_custkey % 3 WHEN 0 THEN 'Data' WHEN 1 THEN 'data' END END AS sheet, c_custkey AS k,
    c_custkey % 4 < 3 AND c_custkey % 3 < 2 AS found FROM customer""")
def resolve_decisions(b):
    found, misses = files.resolve(*_asked(b))
    nothing = F.lit(None).cast("string")
    return found.withColumn("found", F.lit(True)).unionByName(misses.select(nothing.alias("file"), nothing.alias("sheet"), "k", F.lit(False).alias("found")))


# ---- entities, enrichment, quality -------------------------------------------------------------------------------


def spelled_customers(b) -> DataFrame:
    """Four spellings of every customer: as is, with legal form, with a letter missing, with a letter replaced."""
    name = F.col("c_name")
    variants = F.array(
        name, F.concat(F.upper(name), F.lit(", Inc.")), F.regexp_replace(name, "Customer", "Custmer"), F.regexp_replace(name, "Customer", "Custoner")
    )
    return b.raw("customer").select("c_custkey", F.posexplode(variants).alias("v", "name"))


_SPELLED = """SELECT c_custkey, unnest([c_name, upper(c_name) || ', Inc.', replace(c_name, 'Customer', 'Custmer'), replace(c_name, 'Customer', 'Custoner')]) AS name,
    upper(c_name) || ', Inc.' AS longest, generate_subscripts([1, 2, 3, 4], 1) AS spelling FROM customer"""


@register(f"SELECT name, CASE WHEN spelling <= 2 THEN longest ELSE name END AS canonical FROM ({_SPELLED})")
def name_groups(b):
    return entities.name_groups(spelled_customers(b)).select("name", "canonical")


@register(f"SELECT c_custkey, name AS original, longest AS customer_name FROM ({_SPELLED})")
def entity_merge(b):
    spelled = spelled_customers(b).select("c_custkey", F.col("name").alias("original"), F.concat(F.lit(" "), "name").alias("customer_name"))
    merges = entities.merge_map(entities.name_groups(spelled, "original"), min_score=0.9)
    return enrich.apply_merges(spelled, merges)


@register("""SELECT near, lower(regexp_replace(kept, '[^A-Za-z0-9]+', ' ', 'g')) AS near_key, 1.0::DOUBLE - 1.0::DOUBLE / greatest(length(near), length(kept)) AS score
    FROM (SELECT lower(replace(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'), 'Customer', unnest(['Custmer', 'Custoner']))) AS near, c_name AS kept FROM customer)""")
def near_names(b):
    return entities.near_names(entities.name_groups(spelled_customers(b))).select(F.col("key").alias("near"), "near_key", "score")


def trading_names(b: Bindings) -> DataFrame:
    """Every customer under names that share words: in another order, in the plural, with words missing."""
    name, nation = F.col("c_name"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))
    variants = F.array(
        F.concat(name, F.lit(" Holdings "), nation, F.lit(" Trade")), F.concat(nation, F.lit(" Trade Holding "), name),
        F.concat(name, F.lit(" Trade")), F.concat("c_mktsegment", F.lit(" "), name, F.lit(" Trades")))
    return b.raw("customer").select(F.explode(variants).alias("name"))


@register("""
WITH names AS (SELECT DISTINCT unnest([c_name || ' Holdings Nation ' || c_nationkey || ' Trade', 'Nation ' || c_nationkey || ' Trade Holding ' || c_name,
    c_name || ' Trade', c_mktsegment || ' ' || c_name || ' Trades']) AS name FROM customer),
tokened AS (SELECT name, list_sort(list_distinct([CASE WHEN regexp_matches(w, '^.{2,}[^s]s$') THEN w[:-2] ELSE w END
    FOR w IN string_split(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')), ' ')])) AS tokens FROM names),
sets AS (SELECT tokens, arg_min(name, (-length(name), name)) AS canonical FROM tokened GROUP BY tokens),
words AS (SELECT canonical, unnest(tokens) AS token FROM sets),
weights AS (SELECT token, CAST(round(1000 * ln(1 + (SELECT count(*) FROM sets)::DOUBLE / count(*))) AS BIGINT) AS weight FROM words GROUP BY token),
totals AS (SELECT canonical, CAST(sum(weight) AS BIGINT) AS total FROM words JOIN weights USING (token) GROUP BY canonical),
shared AS (SELECT a.canonical, b.canonical AS other, CAST(sum(weight) AS BIGINT) AS common
    FROM words a JOIN words b ON a.token = b.token AND a.canonical < b.canonical JOIN weights w ON w.token = a.token GROUP BY a.canonical, b.canonical)
SELECT s.canonical, other, common, x.total + y.total - common AS "union", 100 * common // (x.total + y.total - common) AS score
FROM shared s JOIN totals x ON x.canonical = s.canonical JOIN totals y ON y.canonical = other WHERE 100 * common >= 60 * (x.total + y.total - common)""")
def token_names(b):
    return similar_names.similar_names(entities.name_groups(trading_names(b)))


@register("""SELECT * EXCLUDE (p) FROM (SELECT client_id, customer_segment, loss_reason, deal_id, discount_pct::DOUBLE AS discount_pct,
    row_number() OVER (PARTITION BY client_id, customer_segment, loss_reason ORDER BY deal_close_date DESC, CAST(deal_id AS BIGINT) DESC) AS p FROM deals) WHERE p = 1""")
def dedup_keep_last(b):
    rows = b.fact_deal_opportunity.select("client_id", "customer_segment", "loss_reason", "deal_id", numeric.num("discount_pct").alias("discount_pct"), "deal_close_date")
    order = F.struct(F.col("deal_close_date"), F.col("deal_id").cast("long"))
    return enrich.dedup_deals(rows, order, ("client_id", "customer_segment", "loss_reason")).drop("deal_close_date")


@register("""SELECT c_custkey, c_name AS customer_name, CASE WHEN c_custkey % 2 = 0 THEN 'Known' WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS industry,
    CASE WHEN c_custkey % 3 = 0 THEN 'SMB' END AS segment FROM customer""")
def enrich_fill(b):
    customers = b.raw("customer").select("c_custkey", F.col("c_name").alias("customer_name"), F.when(F.col("c_custkey") % 2 == 0, "Known").alias("industry"))
    lookup = b.raw("customer").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("industry"), F.lit("SMB").alias("segment"))
    return enrich.enrich(customers, lookup, fields=("industry", "segment"))


@register("""SELECT s_suppkey AS id, s_acctbal AS revenue, CASE WHEN s_acctbal < 0 THEN 'credit/adjustment' ELSE 'standard' END AS revenue_type FROM supplier
    UNION ALL SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'credit/adjustment' ELSE 'standard' END FROM customer""")
def flag_negative(b):
    rows = b.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("revenue")).unionByName(
        b.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("revenue"))
    )
    return enrich.flag_negative(rows)


_LINES = ("Net Sales", "Cost of Sales", "Gross margin", "Office rent", "EBITDA", "Other items", "MRR growth", "Depreciation", "Interest income", "Net position")
_LINE_CATEGORY = ("revenue", "revenue", "margin", "expense", "margin", "uncategorized", "revenue", "expense", "revenue", "margin")


@register("SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_LINE_CATEGORY)) + " END AS category FROM orders")
def categorize(b):
    item = F.element_at(F.array(*[F.lit(x) for x in _LINES]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return enrich.categorize(b.raw("orders").select("o_orderkey", item.alias("line_item"))).drop("line_item")


@register("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 1 THEN (CAST(l_partkey % 50 + 1 AS DOUBLE) - l_quantity) / CAST(l_partkey % 50 + 1 AS DOUBLE) * 100 END AS discount_pct FROM lineitem""")
def derive_discount(b):
    listed = F.when(F.col("l_linenumber") > 1, (F.col("l_partkey") % 50 + 1).cast("double")).otherwise(0.0)
    rows = b.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", listed.alias("list_price"), F.col("l_quantity").alias("invoice_price"))
    return enrich.derive_discount(rows).drop("list_price", "invoice_price")


@register("""
SELECT 'lines' AS "table", b AS bronze_rows, s AS silver_rows, s - b AS row_delta, 11 AS bronze_cols, 11 AS silver_cols, br AS bronze_revenue, sr AS silver_revenue,
    sr - br AS revenue_delta, bc AS bronze_customers, bc AS silver_customers
FROM (SELECT count(*) AS b, sum(l_quantity) AS br, count(DISTINCT l_returnflag) AS bc FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)),
    (SELECT count(*) AS s, sum(l_quantity) AS sr FROM (SELECT DISTINCT * FROM lineitem))
UNION ALL
SELECT 'orders', count(*), count(*), 0, 6, 6, NULL, NULL, NULL, count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) FROM orders""")
def reconcile(b):
    """Whole tables, the line items with some loaded twice."""
    lines = b.raw("lineitem").withColumnsRenamed({"l_returnflag": "customer_name", "l_quantity": "revenue"})
    lines = lines.unionByName(lines.filter("l_linenumber = 1"))
    orders = b.raw("orders").withColumnsRenamed({"o_orderpriority": "customer_name"})
    return quality.reconcile({"lines": lines, "orders": orders}, {"lines": clean.clean(lines, "lines", {})[0], "orders": clean.clean(orders, "orders", {})[0]})


@register("""SELECT 'fact_revenue' AS fact, 'dim_product' AS dim, client_id, product_sku, count(*) AS rows FROM fact_revenue f
    WHERE NOT EXISTS (SELECT 1 FROM dim_product p WHERE p.client_id = f.client_id AND p.product_sku = f.product_sku) GROUP BY ALL""")
def fk_orphans(b):
    return quality.orphans(b.fact_revenue, b.dim_product, ["client_id", "product_sku"], "fact_revenue", "dim_product")


@register(f"""
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM (
    SELECT *, (completeness * 0.4::DOUBLE + validity * 0.2::DOUBLE + uniqueness * 0.2::DOUBLE + integrity * 0.2::DOUBLE) * 100 AS score FROM (
        SELECT d.client_id, 'fact_deal_opportunity' AS "table", count(*) AS rows,
            CAST(count(deal_id) + count(deal_outcome) + count(loss_reason) AS DOUBLE) / CAST(count(*) * 3 AS DOUBLE) AS completeness,
            CAST(count(*) FILTER (discount_pct BETWEEN 0 AND 20) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS validity,
            CAST(count(DISTINCT deal_id) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS uniqueness,
            CAST(count(*) FILTER (EXISTS (SELECT 1 FROM recurring r WHERE r.client_id = d.client_id AND r.customer_id = d.customer_id)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS integrity
        FROM deals d GROUP BY d.client_id))""")
def quality_score(b):
    valid = F.col("discount_pct").between(0, 20)
    return quality.quality_score(
        b.fact_deal_opportunity, "fact_deal_opportunity", ["deal_id", "deal_outcome", "loss_reason"], ["deal_id"], valid, {"customer_id": b.fact_recurring_revenue}
    )


@register("""
SELECT c.client_id, analysis, missing = '' AS is_covered, missing FROM (SELECT DISTINCT client_id FROM deals) c, (VALUES
    ('Pocket Price Waterfall', ''),
    ('Margin Bridge', ''),
    ('Price-Volume-Mix', ''),
    ('Customer Profitability', 'dim_customer.customer_name'),
    ('Discount Effectiveness', ''),
    ('Price Elasticity', ''),
    ('Contract Leakage', 'dim_contract.contracted_price'),
    ('Deal Scorecard', ''),
    ('Competitive Position', 'fact_competitive_intel.competitor_price'),
    ('Price Corridor', ''),
    ('SKU Pareto', ''),
    ('New Product Pricing', 'dim_product.current_list_price, fact_competitive_intel.competitor_price'),
    ('Churn Risk', ''),
    ('Geographic Pricing', ''),
    ('Channel Conflict', ''),
    ('Promotion ROI', 'dim_promotion.promotion_start_date, dim_promotion.promotional_cost'),
    ('Cost-to-Serve', 'fact_cost_to_serve.service_cost'),
    ('Rebate Optimization', 'fact_rebate_incentive.accrued_amount, fact_rebate_incentive.paid_amount'),
    ('Annual Escalation', 'fact_list_price_history.effective_date, fact_list_price_history.list_price'),
    ('Win/Loss', '')) a(analysis, missing)""")
def analysis_coverage(b):
    have = quality.available_columns({"fact_revenue": b.fact_revenue, "fact_deal_opportunity": b.fact_deal_opportunity})
    return quality.analysis_coverage(have)


def context_facts(b) -> DataFrame:
    """What four sources say about every customer."""
    k = F.col("c_custkey")
    def fact(field, value, source, seq):
        return F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"), F.lit(seq).alias("seq"))

    said = F.array(
        fact("industry", F.col("c_mktsegment"), "inferred-from-data", 1),
        fact("industry", F.when(k % 2 == 0, "Energy").otherwise(" "), "extracted-from-deck.pptx", 2),
        fact("industry", F.when(k % 3 == 0, "Retail"), "team-entered", 3),
        fact("company_name", F.col("c_name"), "extracted-from-text", 1),
        fact("product_type", F.when(k % 5 == 0, "Licensing").otherwise("[]"), "team-entered", 1),
    )
    return b.raw("customer").select(k.cast("string").alias("client_id"), F.explode(said).alias("s")).select("client_id", "s.*")


@register("""
SELECT CAST(c_custkey AS VARCHAR) AS client_id, 'industry' AS field, CASE WHEN c_custkey % 3 = 0 THEN 'Retail' WHEN c_custkey % 2 = 0 THEN 'Energy' ELSE c_mktsegment END AS value,
    CASE WHEN c_custkey % 3 = 0 THEN 'team-entered' WHEN c_custkey % 2 = 0 THEN 'extracted-from-deck.pptx' ELSE 'inferred-from-data' END AS source,
    (c_custkey % 2 = 0)::BIGINT + (c_custkey % 3 = 0)::BIGINT AS alternatives FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'company_name', c_name, 'extracted-from-text', 0 FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'product_type', 'Licensing', 'team-entered', 0 FROM customer WHERE c_custkey % 5 = 0""")
def context_merge(b):
    return context.merge_context(context_facts(b))


@register("""SELECT CAST(c_custkey AS VARCHAR) AS client_id, 4 - (c_custkey % 5 = 0)::INT AS missing,
    CASE WHEN c_custkey % 5 = 0 THEN 'business_model, revenue_range, engagement_goal' ELSE 'business_model, revenue_range, product_type, engagement_goal' END AS fields,
    false AS is_complete FROM customer""")
def context_missing(b):
    facts = context_facts(b)
    return context.missing_fields(context.merge_context(facts), facts)


_DEAL_COLUMNS = ("deal_id", "customer_id", "deal_outcome", "deal_close_date", "deal_value", "final_price", "discount_pct", "sales_cycle_days", "sales_rep_id",
                 "customer_segment", "loss_reason", "competitor_cited", "override_flag")
_FILLED = " UNION ALL ".join(f"SELECT client_id, '{c}' AS c, count(*) AS n, count({c}) AS f FROM deals GROUP BY client_id" for c in _DEAL_COLUMNS)


@register(f"""SELECT client_id, c AS "column", n AS rows, f AS filled, {pct('f', 'n')} AS fill_pct, {pct('f', 'n')} < 80 AS is_low FROM ({_FILLED})""")
def fill_rate(b):
    return profile.fill_rates(b.fact_deal_opportunity, ["client_id"])


@register("""
SELECT i AS position, c AS "column", (SELECT count(*) FROM customer) AS rows, 5 AS columns, (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT c_custkey AS k,
    CASE i WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_name WHEN 2 THEN CAST(c_nationkey AS VARCHAR) WHEN 3 THEN CAST(c_acctbal AS VARCHAR) ELSE c_mktsegment END AS v
    FROM customer WHERE i < 4 OR c_custkey % 4 > 0 ORDER BY k LIMIT 3)) AS samples
FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment')) t(i, c)""")
def column_profile(b):
    rows = b.raw("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")))
    return profile.profile(rows, F.col("c_custkey")).withColumn("samples", F.array_join("samples", "|"))


@register("""
SELECT c AS "column", count(v) AS filled, array_to_string(list_sort(list(DISTINCT v))[1:5], '|') AS samples FROM (
    SELECT 'o_orderpriority' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
    UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'event_type', event_type FROM events) GROUP BY c""")
def column_inventory(b):
    def cells(table, *columns):
        return profile.unpivot_text(b.raw(table), F.lit(0), list(columns)).select("column", "value")
    every = cells("orders", "o_orderpriority", "o_orderstatus").unionByName(cells("part", "p_name", "p_type")).unionByName(cells("events", "event_type"))
    return profile.inventory(every).withColumn("samples", F.array_join("samples", "|"))


@register("""
SELECT c AS "column", k AS "check", n AS violations FROM (SELECT 'client_name' AS c, 'present' AS k, count(*) FILTER (o_orderkey % 8 = 0) AS n FROM orders
    UNION ALL SELECT 'pepm_rate', 'numeric', count(*) FILTER (o_orderkey % 9 = 0) FROM orders
    UNION ALL SELECT 'lives_covered', 'numeric', 0)""")
def benefits_checks(b):
    key = F.col("o_orderkey")
    rows = b.raw("orders").select(
        F.when(key % 8 == 0, " ").otherwise(F.col("o_orderpriority")).alias("client_name"),
        F.when(key % 9 == 0, "n/a").otherwise("1.5").alias("pepm_rate"), F.col("o_custkey").cast("string").alias("lives_covered"),
    )
    return quality.benefits_checks(rows)


@register("""
SELECT c_custkey AS customer_id, r_name AS client_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM home
UNION ALL SELECT c_custkey + 1000000000, r_name, 'new' FROM home WHERE c_custkey % 2 = 0""")
def keyed_merge(b):
    target = b.home.select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("client_id"), F.lit("old").alias("state"))
    even = target.filter(F.col("customer_id") % 2 == 0)
    source = even.withColumn("state", F.lit("new")).withColumn("load", F.lit(2)).unionByName(
        even.withColumn("customer_id", F.col("customer_id") + 1000000000).withColumn("state", F.lit("new")).withColumn("load", F.lit(2))
    ).unionByName(even.withColumn("state", F.lit("stale")).withColumn("load", F.lit(1)))
    last = merge_into(None, source, ["client_id", "customer_id"], F.col("load")).drop("load")
    return merge_into(target, last, ["client_id", "customer_id"])




# ---- rules of single values ---------------------------------------------------------------------------------------


@register("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'transaction_fact' ELSE replace(c_mktsegment, ' ', '_') || '_dim' END AS target FROM customer")
def route_decisions(b):
    more = F.when(F.col("c_custkey") % 3 == 0, ", contract").when(F.col("c_custkey") % 3 == 1, " + x").otherwise("")
    told = F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" dim"), more))
    return b.raw("customer").select("c_custkey", classify.route(told).alias("target"))


@register("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'transaction_fact' ELSE 'voc_fact' END AS target_table FROM part""")
def benefits_routes(b):
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 3 == 0, "PEPM ").when(key % 3 == 1, "Validated Sales ").otherwise("conjoint "), key.cast("string"))
    return classify.classify(b.raw("part").select("p_partkey", name.alias("name")), routes=BENEFITS_ROUTES).drop("name")


@register("""SELECT o_orderkey, '2:' || d || '|3:' || d AS months FROM (SELECT o_orderkey, strftime(o_orderdate, '2024-%m-15') AS d FROM orders)""")
def month_headers(b):
    day = F.col("o_orderdate")
    header = F.array(F.col("o_orderpriority"), F.date_format(day, "MMM"), F.concat(F.lit(" "), F.upper(F.date_format(day, "MMMM"))))
    found = F.transform(headers.month_positions(header), lambda e: F.concat_ws(":", e["pos"].cast("string"), e["day"].cast("string")))
    return b.raw("orders").select("o_orderkey", F.array_join(found, "|").alias("months"))


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN s_acctbal END AS s_acctbal FROM supplier")
def sanitize_numbers(b):
    bad = F.when(F.col("s_suppkey") % 3 == 0, float("nan")).when(F.col("s_suppkey") % 3 == 1, float("-inf")).otherwise(F.col("s_acctbal"))
    return clean.sanitize(b.raw("supplier").select("s_suppkey", bad.alias("s_acctbal")))


@register("""SELECT nullif(o_orderpriority || ' ' || o_custkey, '3-MEDIUM 7') AS sales_rep_name, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
    FROM orders GROUP BY 1""")
def dedup_reps(b):
    name = F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string"))
    rows = b.raw("orders").select(F.nullif(name, F.lit("3-MEDIUM 7")).alias("sales_rep_name"), "o_orderkey", "o_orderstatus")
    return enrich.dedup_reps(rows, F.col("o_orderkey"))


@register("SELECT c_name AS customer_name FROM customer WHERE c_custkey % 5 > 0 UNION SELECT s_name FROM supplier")
def name_universe(b):
    real = F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit(" "), "c_name")).otherwise("NaN")
    return enrich.distinct_names([b.raw("customer").select(real.alias("customer_name")), b.raw("supplier").select(F.col("s_name").alias("customer_name")), b.raw("part")])


@register("""SELECT o_orderkey, o_orderkey % 3 > 0 OR o_orderkey % 2 = 0 AS wide FROM orders""")
def wide_detection(b):
    key = F.col("o_orderkey")
    dates = F.array(*[F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 40 * i), "yyyy-MM-dd") for i in range(3)])
    header = F.concat(F.array(F.lit("Customer")), F.when(key % 3 > 0, dates).otherwise(F.slice(dates, 1, 2)))
    sheets = b.raw("orders").select(key.cast("string").alias("file"), F.lit("S").alias("sheet"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"), header.alias("header"))
    told = sheets.select(
        "file", "sheet", F.lit("transaction_fact").alias("target_table"), F.create_map(F.lit("Customer"), F.lit("customer_name")).alias("column_mapping"),
        F.when(F.col("file").cast("long") % 2 == 0, "wide_dates").alias("data_format"), F.array().cast("array<string>").alias("exclude_rules"), F.array().cast("array<string>").alias("id_columns"),
    )
    return reshape.sheet_plans(sheets, told).select(F.col("file").cast("long").alias("o_orderkey"), "wide")


@register("""SELECT r.transaction_id, r.product_sku, CAST(CAST(h.effective_date AS DATE) AS VARCHAR) AS effective_date, CAST(h.list_price AS DOUBLE) AS list_price,
    CAST(h.list_price - r.invoice_price AS DOUBLE) AS below_list
    FROM fact_revenue r ASOF LEFT JOIN price_history h ON r.product_sku = h.product_sku AND r.transaction_date >= h.effective_date""")
def price_in_force(b):
    sold = b.fact_revenue.select("transaction_id", "product_sku", "transaction_date", "invoice_price")
    priced = asof.as_of(sold, b.fact_list_price_history, ["product_sku"], "transaction_date", "effective_date", ["list_price"])
    return priced.select("transaction_id", "product_sku", "effective_date", numeric.num("list_price").alias("list_price"),
                         numeric.num(F.col("list_price") - F.col("invoice_price")).alias("below_list"))


@register("""SELECT client_id, sales_channel, geography, CAST(grouping_id(client_id, sales_channel, geography) AS BIGINT) AS level,
    CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity, count(*) AS rows
    FROM fact_revenue GROUP BY CUBE (client_id, sales_channel, geography)""")
def revenue_cube(b):
    cube = filters.grouped_sets(b.fact_revenue, ["client_id", "sales_channel", "geography"], {"revenue": "revenue", "quantity": "quantity"})
    return cube.withColumns({c: numeric.num(c) for c in ("revenue", "quantity")})


@register("""SELECT client_id, sales_channel, geography, CAST(grouping_id(client_id, sales_channel, geography) AS BIGINT) AS level,
    CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) AS rows FROM fact_revenue GROUP BY GROUPING SETS ((client_id, geography), (sales_channel), ())""")
def revenue_sets(b):
    sets = [["client_id", "geography"], ["sales_channel"], []]
    return filters.grouped_sets(b.fact_revenue, ["client_id", "sales_channel", "geography"], {"revenue": "revenue"}, sets).withColumn("revenue", numeric.num("revenue"))


def _files_of_cells(b) -> DataFrame:
    """Text cells of several tables, each dealt to files by a key."""
    def cells(table, key, *columns):
        rows = b.raw(table).withColumn("file", F.concat(F.lit(f"{table}-"), F.col(key) % 7))
        listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        return rows.select("file", F.explode(listed).alias("c")).select("file", "c.*")
    parts = cells("orders", "o_orderkey", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), cells("part", "p_partkey", "p_name", "p_type"), cells("lineitem", "l_orderkey", "l_returnflag", "l_partkey")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CELL_COLUMNS = (("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("part", "p_name"), ("part", "p_type"), ("lineitem", "l_returnflag"), ("lineitem", "l_partkey"))


@register(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS filled, CAST(min(length(CAST({c} AS VARCHAR))) AS INTEGER) AS shortest,
    CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER) AS longest, min(CAST({c} AS VARCHAR)) AS smallest, max(CAST({c} AS VARCHAR)) AS largest,
    count(DISTINCT {c}) AS n_distinct, true AS distinct_within, true AS frequent_within FROM {t}""" for t, c in _CELL_COLUMNS))
def merged_profiles(b):
    """Sketches per file, merged, beside the exact counts that bound their errors."""
    cells = _files_of_cells(b)
    merged = sketches.profile_of(sketches.merge_sketches(sketches.sketch_columns(cells)), 1)
    counts = sketches.exact_counts(cells)
    exact = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most"))
    near = F.abs(F.col("n_distinct") - F.col("n")) <= 4 * sketches.HLL_ERROR * F.col("n") + 1
    top = F.coalesce(F.get("frequent", F.lit(0))["count"], F.lit(0))
    listed = (F.col("most") * sketches.FOLLOWED <= F.col("rows")) | (F.abs(top - F.col("most")) * sketches.FOLLOWED <= 2 * F.col("rows"))
    return merged.join(exact, "column").select("column", "rows", "filled", "shortest", "longest", "smallest", "largest", F.col("n").alias("n_distinct"),
                                               near.alias("distinct_within"), listed.alias("frequent_within"))


@register("""
SELECT CAST(c_custkey AS VARCHAR) AS client_id, f AS field, v AS value FROM (
    SELECT c_custkey, unnest([{f: 'company_name', v: c_name}, {f: 'profile.industry.value', v: lower(c_mktsegment)}, {f: 'profile.industry.source', v: 'team-entered'},
        {f: 'profile.size', v: CAST(c_nationkey AS VARCHAR)}, {f: 'tags', v: '["a","' || c_mktsegment || '"]'}, {f: 'contacts.0.name', v: 'first ' || c_custkey},
        {f: 'contacts.1.name', v: 'second'}, {f: 'nothing', v: NULL}], recursive := true) FROM customer WHERE c_custkey % 10 > 0) WHERE v IS NOT NULL""")
def context_files(b):
    industry = F.struct(F.lower("c_mktsegment").alias("value"), F.lit("team-entered").alias("source"))
    contacts = F.array(F.struct(F.concat(F.lit("first "), F.col("c_custkey").cast("string")).alias("name")), F.struct(F.lit("second").alias("name")))
    document = F.to_json(F.struct(
        F.col("c_name").alias("company_name"), F.struct(industry.alias("industry"), F.col("c_nationkey").alias("size")).alias("profile"),
        F.array(F.lit("a"), "c_mktsegment").alias("tags"), contacts.alias("contacts"), F.lit(None).cast("string").alias("nothing")), {"ignoreNullFields": "false"})
    cut = F.when(F.col("c_custkey") % 10 == 0, F.substring(document, F.lit(1), F.length(document) - 3)).otherwise(document)
    files = b.raw("customer").select(F.col("c_custkey").cast("string").alias("client_id"), cut.alias("content"))
    return context.flatten_json(files)[0].select("client_id", "field", "value")


SQL = {name: statement(sql) for name, sql in _SQL.items()}
