"""Per-client views over invoiced revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_text
from ..functions.numeric import fixed_sum, money, num, percent, ratio, thousands, total
from ..operators.ordering import running

# Amounts given away outside the invoice line itself.
OFF_INVOICE = ("rebate_amount", "freight_absorption", "co_op_marketing", "credit_memo_amount", "prompt_pay_discount")

# Waterfall steps between list and invoice, in drawing order: output column and source amount.
WATERFALL_STEPS = {
    "volume_discount_pct": "volume_discount",
    "prompt_pay_pct": "prompt_pay_discount",
    "rebate_pct": "rebate_amount",
    "freight_pct": "freight_absorption",
    "coop_pct": "co_op_marketing",
    "credit_memo_pct": "credit_memo_amount",
}


def filled(value: str) -> Column:
    return F.coalesce(money(value), money(F.lit(0)))


def _list_amount() -> Column:
    return money("list_price") * money("quantity")


def executive_summary(revenue: DataFrame, clients: DataFrame) -> DataFrame:
    """Headline totals per client.

    Facts shrink to one row per customer and SKU, which gives the sums and both distinct counts in one scan; no task
    ever holds one client's distinct set.
    """
    off_invoice = sum((filled(c) for c in OFF_INVOICE[1:]), filled(OFF_INVOICE[0]))
    totals = (
        revenue.groupBy("client_id", "customer_id", "product_sku")
        .agg(
            total("revenue").alias("rev"),
            total("cogs").alias("cogs"),
            F.sum(_list_amount()).alias("gross"),
            F.sum((money("list_price") - money("invoice_price")) * money("quantity")).alias("given"),
            F.sum(off_invoice).alias("leak"),
        )
        .groupBy("client_id")
        .agg(
            *[F.sum(c).alias(c) for c in ("rev", "cogs", "gross", "given", "leak")],
            F.count_distinct("customer_id").alias("total_customers"),
            F.count_distinct("product_sku").alias("active_products"),
        )
    )
    return (
        clients.join(totals, "client_id", "left")
        .select(
            "client_id", "client_name", "industry",
            num("rev").alias("total_revenue"),
            percent(F.col("rev") - F.col("cogs"), "rev").alias("avg_margin"),
            F.coalesce("total_customers", F.lit(0)).alias("total_customers"),
            F.coalesce("active_products", F.lit(0)).alias("active_products"),
            percent("given", "gross").alias("avg_discount"),
            num("leak").alias("total_leakage"),
            "gold_status", "silver_status", "last_run_at", "data_quality_grade",
        )
    )


def waterfall(revenue: DataFrame) -> DataFrame:
    """List price = 100; every step as a share of list value; invoice = 100 minus the steps; pocket = invoice - cost."""
    sums = revenue.groupBy("client_id").agg(
        F.sum(_list_amount()).alias("gross"),
        F.sum(filled("cogs")).alias("cogs"),
        *[F.sum(filled(src)).alias(src) for src in WATERFALL_STEPS.values()],
    )
    given = sum((F.col(src) for src in list(WATERFALL_STEPS.values())[1:]), F.col("volume_discount"))
    return sums.select(
        "client_id",
        F.lit(100.0).alias("list_price_index"),
        *[percent(src, "gross").alias(out) for out, src in WATERFALL_STEPS.items()],
        (F.lit(100.0) - percent(given, "gross")).alias("invoice_price_index"),
        percent("cogs", "gross").alias("cogs_index"),
        (F.lit(100.0) - percent(given + F.col("cogs"), "gross")).alias("pocket_margin_index"),
    )


def revenue_trend(revenue: DataFrame) -> DataFrame:
    """Monthly revenue in $K and margin %."""
    month = F.trunc("transaction_date", "month")
    return (
        revenue.groupBy("client_id", month.alias("month_date"))
        .agg(total("revenue").alias("rev"), total("cogs").alias("cogs"))
        .select(
            "client_id",
            month_text("month_date").alias("month"),
            "month_date",
            thousands("rev").alias("revenue"),
            percent(F.col("rev") - F.col("cogs"), "rev").alias("margin"),
        )
    )


def customer_profitability(revenue: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue in $K, margin % and number of transactions per customer. Facts shrink before the join."""
    sums = revenue.groupBy("client_id", "customer_id").agg(
        total("revenue").alias("rev"), total("cogs").alias("cogs"), F.count(F.lit(1)).alias("size")
    )
    names = customers.select("client_id", "customer_id", "customer_name", "customer_segment")
    return sums.join(names, ["client_id", "customer_id"], "left").select(
        "client_id",
        "customer_id",
        F.col("customer_name").alias("name"),
        thousands("rev").alias("revenue"),
        percent(F.col("rev") - F.col("cogs"), "rev").alias("margin"),
        "size",
        F.col("customer_segment").alias("segment"),
    )


def sku_pareto(revenue: DataFrame) -> DataFrame:
    """SKUs by falling revenue with the running share of the client's total; ties by SKU."""
    skus = revenue.groupBy("client_id", "product_sku").agg(total("revenue").alias("rev"))
    ranked = running(
        skus, ["client_id"], [F.col("rev").desc(), F.col("product_sku")], sums={"cum": F.col("rev")}, totals={"client_rev": "cum"}
    )
    return ranked.select(
        "client_id",
        F.col("product_sku").alias("sku"),
        thousands("rev").alias("revenue"),
        percent("cum", "client_rev").alias("cum_pct"),
    )


def price_volume_mix(revenue: DataFrame) -> DataFrame:
    """Yearly change of revenue split into price, volume and mix, which add up to the total.

    With S = sum over SKUs of last year's price times this year's quantity (a new SKU counts at this year's price):
    price = R1 - S, volume = (Q1 - Q0) * P0, mix = S - Q1 * P0, where P0 = R0 / Q0. One aggregate per SKU and year
    is therefore enough; the window sees one SKU's years only.
    """
    yearly = revenue.groupBy("client_id", "product_sku", F.year("transaction_date").alias("yr")).agg(
        total("revenue").alias("r"), total("quantity").alias("q")
    )
    per_sku = Window.partitionBy("client_id", "product_sku").orderBy("yr")
    price_before = F.when(F.lag("yr").over(per_sku) == F.col("yr") - 1, ratio(F.lag("r").over(per_sku), F.lag("q").over(per_sku)))
    old_price = F.coalesce(price_before, ratio("r", "q"))
    per_year = (
        yearly.withColumn("s", old_price * num("q"))
        .groupBy("client_id", "yr")
        .agg(F.sum("r").alias("r1"), F.sum("q").alias("q1"), fixed_sum("s").alias("s"))
    )
    years = Window.partitionBy("client_id").orderBy("yr")
    paired = per_year.select(
        "*",
        F.lag("yr").over(years).alias("yr0"), F.lag("r1").over(years).alias("r0"), F.lag("q1").over(years).alias("q0"),
    ).filter(F.col("yr0") == F.col("yr") - 1)
    average = ratio("r0", "q0")
    return paired.select(
        "client_id",
        F.col("yr").cast("string").alias("period"),
        (num("r1") - F.col("s")).alias("price"),
        ((num("q1") - num("q0")) * average).alias("volume_effect"),
        (F.col("s") - num("q1") * average).alias("mix"),
        (num("r1") - num("r0")).alias("total"),
    )


def geo_pricing(revenue: DataFrame) -> DataFrame:
    """Average unit price per region against the client's national average."""
    regions = revenue.groupBy("client_id", "geography").agg(total("revenue").alias("rev"), total("quantity").alias("qty"))
    nation = regions.groupBy("client_id").agg(F.sum("rev").alias("all_rev"), F.sum("qty").alias("all_qty"))
    average, national = ratio("rev", "qty"), ratio("all_rev", "all_qty")
    return regions.join(nation, "client_id").select(
        "client_id",
        F.col("geography").alias("region"),
        average.alias("avg_price"),
        national.alias("national"),
        ((average - national) / F.nullif(national, F.lit(0.0)) * 100).alias("variance"),
        num("rev").alias("revenue"),
    )


def month_number(day: str) -> Column:
    return F.year(day) * 12 + F.month(day)


def churn_risk(
    revenue: DataFrame,
    customers: DataFrame,
    recurring: DataFrame,
    recency_days: int = 180,
    weights: tuple[float, float, float] = (40.0, 40.0, 20.0),
) -> DataFrame:
    """Risk 0-100 per customer: time since last purchase, three-month revenue decline, satisfaction.

    Satisfaction is 1 - NPS/10 and neutral (0.5) without a score. Everything is relative to the client's last
    transaction. Facts shrink to customer-months first; the last transaction comes from the same months, columns and all,
    so that one scan and one exchange serve both.
    """
    months = revenue.groupBy("client_id", "customer_id", month_number("transaction_date").alias("m")).agg(
        total("revenue").alias("rev"), F.max("transaction_date").alias("last_day")
    )
    return churn_of_months(months, customers, recurring, recency_days, weights)


def churn_of_months(months: DataFrame, customers: DataFrame, recurring: DataFrame, recency_days: int = 180, weights: tuple[float, float, float] = (40.0, 40.0, 20.0)) -> DataFrame:
    """``churn_risk`` from (client_id, customer_id, m, rev, last_day), one row per customer and month."""
    latest = months.groupBy("client_id").agg(F.max(F.struct("last_day", "m", "rev")).alias("t"))
    anchor = latest.select("client_id", F.col("t.last_day").alias("today"), F.col("t.m").alias("m1"))
    age = F.col("m1") - F.col("m")
    per_customer = (
        months.join(anchor, "client_id")
        .groupBy("client_id", "customer_id")
        .agg(
            F.sum("rev").alias("rev"),
            F.min(F.datediff("today", "last_day")).alias("days"),
            F.sum(F.when(age < 3, F.col("rev")).otherwise(money(F.lit(0)))).alias("recent"),
            F.sum(F.when((age >= 3) & (age < 6), F.col("rev")).otherwise(money(F.lit(0)))).alias("prior"),
        )
    )
    satisfaction = recurring.groupBy("client_id", "customer_id").agg(F.min(num("nps_score")).alias("nps"))
    names = customers.select("client_id", "customer_id", "customer_name")
    recency = F.least(num("days") / float(recency_days), F.lit(1.0))
    change = num("recent") - num("prior")
    decline = F.coalesce(F.least(F.greatest(-change / F.nullif(num("prior"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    unhappy = F.coalesce(1.0 - F.least(F.greatest(F.col("nps"), F.lit(0.0)), F.lit(10.0)) / 10.0, F.lit(0.5))
    return (
        per_customer.join(names, ["client_id", "customer_id"], "left")
        .join(satisfaction, ["client_id", "customer_id"], "left")
        .select(
            "client_id",
            "customer_id",
            F.col("customer_name").alias("name"),
            thousands("rev").alias("revenue"),
            (recency * weights[0] + decline * weights[1] + unhappy * weights[2]).alias("risk_score"),
            F.when(change > 0, "growing").when(change < 0, "declining").otherwise("stable").alias("trend"),
        )
    )


def cohort_revenue(revenue: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Revenue and active customers by month of first purchase and month of revenue.

    With ``customers`` given, a known ``customer_since_date`` sets the cohort instead.
    """
    months = revenue.groupBy("client_id", "customer_id", F.trunc("transaction_date", "month").alias("m")).agg(total("revenue").alias("rev"))
    first = F.min("m").over(Window.partitionBy("client_id", "customer_id"))
    dated = months.withColumn("first", first)
    if customers is not None and "customer_since_date" in customers.columns:
        since = customers.select("client_id", "customer_id", F.trunc("customer_since_date", "month").alias("since"))
        dated = dated.join(since, ["client_id", "customer_id"], "left").withColumn("first", F.coalesce("since", "first"))
    return (
        dated.groupBy("client_id", "first", "m")
        .agg(F.count(F.lit(1)).alias("active_customers"), F.sum("rev").alias("rev"))
        .select(
            "client_id",
            month_text("first").alias("cohort_month"),
            month_text("m").alias("rev_month"),
            "active_customers",
            num(F.round("rev", 2)).alias("revenue"),
        )
    )
