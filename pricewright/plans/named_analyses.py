"""Analyses the dashboard names without computing them; all formulas are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import money, num, percent, ratio, total
from ..operators.intervals import within
from ..operators.ordering import exact_percentiles


def margin_bridge(revenue: DataFrame) -> DataFrame:
    """Yearly change of margin, split into revenue and cost."""
    years = revenue.groupBy("client_id", F.year("transaction_date").alias("yr")).agg(total("revenue").alias("r"), total("cogs").alias("c"))
    w = Window.partitionBy("client_id").orderBy("yr")
    before = years.withColumns({"yr0": F.lag("yr").over(w), "r0": F.lag("r").over(w), "c0": F.lag("c").over(w)})
    return before.filter(F.col("yr0") == F.col("yr") - 1).select(
        "client_id",
        F.col("yr").cast("string").alias("period"),
        num(F.col("r0") - F.col("c0")).alias("margin_before"),
        num(F.col("r") - F.col("r0")).alias("revenue_effect"),
        num(F.col("c0") - F.col("c")).alias("cost_effect"),
        num(F.col("r") - F.col("c")).alias("margin_after"),
    )


def price_elasticity(revenue: DataFrame) -> DataFrame:
    """Slope of log quantity over log price of each SKU's months, to four digits; null where prices differ by less than 0.1 %."""
    months = revenue.groupBy("client_id", "product_sku", F.trunc("transaction_date", "month").alias("m")).agg(
        total("revenue").alias("r"), total("quantity").alias("q")
    ).filter((F.col("r") > 0) & (F.col("q") > 0))
    priced = months.withColumn("p", ratio("r", "q"))
    slope = F.round(F.regr_slope(F.ln(num("q")), F.ln("p")), 4) + F.lit(0.0)  # no negative zero
    return priced.groupBy("client_id", "product_sku").agg(
        F.when(F.max("p") > F.min("p") * 1.001, slope).alias("elasticity"), F.count(F.lit(1)).alias("months")
    )


def channel_conflict(revenue: DataFrame) -> DataFrame:
    """Spread of a SKU's average price between its sales channels, in percent of the lowest."""
    channels = revenue.groupBy("client_id", "product_sku", "sales_channel").agg(total("revenue").alias("r"), total("quantity").alias("q"))
    priced = channels.withColumn("p", ratio("r", "q"))
    return priced.groupBy("client_id", "product_sku").agg(
        F.count("p").alias("channels"), F.min("p").alias("lowest_price"), F.max("p").alias("highest_price")
    ).filter(F.col("channels") > 1).withColumn("spread_pct", (F.col("highest_price") - F.col("lowest_price")) / F.nullif("lowest_price", F.lit(0.0)) * 100)


def annual_escalation(history: DataFrame) -> DataFrame:
    """Change of each list price against the SKU's one before. A SKU's price history is one small group."""
    w = Window.partitionBy("client_id", "product_sku").orderBy("effective_date")
    before = history.withColumn("before", F.lag(money("list_price")).over(w)).filter(F.col("before").isNotNull())
    return before.select(
        "client_id", "product_sku", "effective_date", num("before").alias("price_before"), num("list_price").alias("price_after"),
        percent(money("list_price") - F.col("before"), "before").alias("escalation_pct"),
    )


def contract_leakage(revenue: DataFrame, contracts: DataFrame) -> DataFrame:
    """Revenue lost by invoicing below the contracted price while a contract runs, per contract.

    Transactions shrink to one row per customer, day and price before they meet the contracts.
    """
    daily = revenue.groupBy("client_id", "customer_id", F.col("transaction_date").alias("day"), money("invoice_price").alias("p")).agg(
        total("quantity").alias("q"), F.count(F.lit(1)).alias("n")
    )
    terms = contracts.select("client_id", "customer_id", "contract_id", "contract_start_date", "contract_end_date", money("contracted_price").alias("agreed"))
    met = within(daily, terms, ["client_id", "customer_id"], "day", "contract_start_date", "contract_end_date")
    gap = (F.col("agreed") - F.col("p")) * F.col("q")
    below = F.col("p") < F.col("agreed")
    return met.groupBy("client_id", "contract_id").agg(
        F.sum("n").alias("transactions"),
        F.sum(F.when(below, F.col("n")).otherwise(0)).alias("below_contract"),
        num(F.sum(F.when(below, gap).otherwise(F.lit(0).cast("decimal(38,8)")))).alias("leakage"),
    )


def price_corridor(revenue: DataFrame) -> DataFrame:
    """10th, 50th and 90th percentile of a SKU's invoice price, exact at any size."""
    priced = revenue.select("client_id", "product_sku", money("invoice_price").alias("p"))
    edges = exact_percentiles(priced, ["client_id", "product_sku"], "p", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return edges.select("client_id", "product_sku", *[num(n).alias(n) for n in ("p10", "p50", "p90")], F.col("_rows").alias("transactions"))
