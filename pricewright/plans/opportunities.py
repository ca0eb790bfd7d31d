"""Ranked pricing opportunities: one rule per source, impact in money, rank per client."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fixed_sum, money, num, ratio, total
from .revenue_views import churn_of_months, month_number


@dataclass(frozen=True)
class Policy:
    """Thresholds of the rules."""

    max_discount: float = 15.0
    region_gap_pct: float = -0.5
    risk_score: float = 70.0
    recoverable: float = 0.5


def _row(df: DataFrame, impact, kind: str, analysis: str, confidence: str, text: str) -> DataFrame:
    return df.groupBy("client_id").agg(impact.alias("impact_mid")).select(
        "client_id",
        F.lit(kind).alias("type"),
        F.lit(analysis).alias("analysis"),
        num("impact_mid").alias("impact_mid"),
        F.lit(confidence).alias("confidence"),
        F.lit(text).alias("description"),
    )


def sales_cells(revenue: DataFrame) -> DataFrame:
    """Sums per client, customer, region and month: all that the rules need of the facts.

    The filter asks for every column and drops nothing that counts, so that each rule reads the same aggregate and Spark
    computes it, scan and shuffle, once.
    """
    cells = revenue.groupBy("client_id", "customer_id", "geography", month_number("transaction_date").alias("m")).agg(
        total("revenue").alias("rev"), total("cogs").alias("cogs"), total("quantity").alias("qty"), F.max("transaction_date").alias("last_day"))
    return cells.filter(F.coalesce("rev", "cogs", "qty").isNotNull() | F.col("last_day").isNotNull())


def opportunities(
    revenue: DataFrame, deals: DataFrame, rebates: DataFrame, customers: DataFrame, recurring: DataFrame, policy: Policy = Policy()
) -> DataFrame:
    """Union of the rules; priority 1 is the largest impact. A rule yields at most one row per client."""
    cells = sales_cells(revenue)
    excess = money("discount_pct") - money(F.lit(policy.max_discount))
    discounts = _row(
        deals.filter((F.col("deal_outcome") == "Won") & (excess > 0)),
        num(F.sum(excess * money("deal_value"))) / 100,
        "Discount", "Discount Effectiveness", "High", "Won deals discounted above policy",
    )
    margin = cells.groupBy("client_id", "customer_id").agg((F.sum("rev") - F.sum("cogs")).alias("m"))
    losses = _row(
        margin.filter(F.col("m") < 0), -F.sum("m"), "Margin", "Customer Profitability", "High", "Customers sold below cost"
    )
    leakage = _row(
        rebates, F.sum(money("accrued_amount") - money("paid_amount")),
        "Rebate", "Rebate Optimization", "Medium", "Rebates accrued but not paid out",
    )
    regions = cells.groupBy("client_id", "geography").agg(F.sum("rev").alias("r"), F.sum("qty").alias("q"))
    nation = regions.groupBy("client_id").agg(ratio(F.sum("r"), F.sum("q")).alias("national"))
    gap = (ratio("r", "q") - F.col("national")) / F.col("national") * 100
    pricing = _row(
        regions.join(nation, "client_id").filter(gap < policy.region_gap_pct),
        fixed_sum(F.col("national") * num("q") - num("r")),
        "Geography", "Geographic Pricing", "Medium", "Regions priced below the national average",
    )
    months = cells.groupBy("client_id", "customer_id", "m").agg(F.sum("rev").alias("rev"), F.max("last_day").alias("last_day"))
    churn = churn_of_months(months, customers, recurring)
    risk = _row(
        churn.filter(F.col("risk_score") > policy.risk_score),
        fixed_sum(F.col("revenue") * 1000 * policy.recoverable),
        "Retention", "Churn Risk", "Low", "Revenue of customers likely to leave",
    )
    rules = discounts.unionByName(losses).unionByName(leakage).unionByName(pricing).unionByName(risk)
    rank = Window.partitionBy("client_id").orderBy(F.col("impact_mid").desc(), "type")
    return rules.filter(F.col("impact_mid") > 0).withColumn("priority", F.row_number().over(rank))
