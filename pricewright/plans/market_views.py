"""Per-client views over competitors, rebates, cost to serve, new products and promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean_of, money, num, percent, ratio, round_half_up, total
from ..operators.intervals import within

# The components of cost to serve.
SERVE_COSTS = (
    "service_cost", "logistics_cost", "returns_credits_cost", "intermediary_cost",
    "customization_cost", "payment_terms_cost", "sales_coverage_cost",
)


def competitive_intel(intel: DataFrame, products: DataFrame) -> DataFrame:
    """Average competitor price and feature score per competitor, SKU, segment, geography and price type."""
    keys = ["client_id", "competitor_name", "own_product_sku", "market_segment", "geography", "price_type", "confidence_level"]
    sums = intel.groupBy(*keys).agg(
        mean_of("competitor_price").alias("p"),
        F.count(F.lit(1)).alias("observations"),
        mean_of("feature_comparison_score").alias("avg_feature_score"),
    )
    names = products.select("client_id", F.col("product_sku").alias("own_product_sku"), "product_name", "product_category")
    return sums.join(names, ["client_id", "own_product_sku"], "left").select(
        "client_id",
        "competitor_name",
        "own_product_sku",
        F.col("product_name").alias("own_product_name"),
        "product_category",
        "market_segment",
        "geography",
        "price_type",
        round_half_up(F.col("p"), 2).alias("avg_competitor_price"),
        "observations",
        "avg_feature_score",
        "confidence_level",
    )


def rebate_analysis(rebates: DataFrame, customers: DataFrame) -> DataFrame:
    """Accrued, claimed and paid rebates with payout rate (percent) and leakage (accrued - paid)."""
    sums = rebates.groupBy("client_id", "customer_id", "rebate_type", "period").agg(
        total("accrued_amount").alias("a"), total("claimed_amount").alias("c"), total("paid_amount").alias("p")
    )
    names = customers.select("client_id", "customer_id", "customer_name", "customer_segment")
    return sums.join(names, ["client_id", "customer_id"], "left").select(
        "client_id",
        "customer_name",
        "customer_id",
        F.col("customer_segment").alias("segment"),
        "rebate_type",
        "period",
        num(F.round("a", 2)).alias("total_accrued"),
        num(F.round("c", 2)).alias("total_claimed"),
        num(F.round("p", 2)).alias("total_paid"),
        percent("p", "a").alias("payout_rate"),
        num(F.col("a") - F.col("p")).alias("leakage"),
    )


def cost_to_serve(costs: DataFrame, customers: DataFrame) -> DataFrame:
    """The seven cost components per customer and period, and their sum with missing ones as zero."""
    zero = money(F.lit(0))
    whole = sum((F.coalesce(money(c), zero) for c in SERVE_COSTS[1:]), F.coalesce(money(SERVE_COSTS[0]), zero))
    names = customers.select("client_id", "customer_id", "customer_name", "customer_segment", "geography_primary")
    return costs.join(names, ["client_id", "customer_id"], "left").select(
        "client_id",
        "customer_name",
        "customer_id",
        "customer_segment",
        F.col("geography_primary").alias("region"),
        "period",
        *[num(c).alias(c) for c in SERVE_COSTS],
        num(F.round(whole, 2)).alias("total_cost_to_serve"),
        "order_frequency",
        "avg_order_size",
    )


def new_product_pricing(
    products: DataFrame, history: DataFrame, intel: DataFrame, statuses: tuple[str, ...] = ("Beta", "Pipeline")
) -> DataFrame:
    """Products not yet generally sold: margin, last price change, market position and a suggested price.

    Suggested price = competitor average x (0.9 + 0.2 x feature score); without competitors the list price.
    Position: Premium above +5 % of the market, Underpriced below -5 %.
    """
    key = ["client_id", "product_sku"]
    change = F.struct(money("previous_list_price").alias("p"), money("change_pct").alias("c"), F.col("change_reason").alias("r"))
    latest = history.groupBy(*key).agg(
        F.max("effective_date").alias("last_price_change_date"), F.max_by(change, "effective_date").alias("h")
    )
    # First per competitor: a much-observed SKU then carries one row per competitor, not per observation.
    market = (
        intel.groupBy("client_id", F.col("own_product_sku").alias("product_sku"), "competitor_name")
        .agg(
            total("competitor_price").alias("ps"), F.count("competitor_price").alias("pn"),
            total("feature_comparison_score").alias("fs"), F.count("feature_comparison_score").alias("fn"),
        )
        .groupBy(*key)
        .agg(
            ratio(F.sum("ps"), F.sum("pn")).alias("avg_competitor_price"),
            ratio(F.sum("fs"), F.sum("fn")).alias("avg_feature_score"),
            F.count("competitor_name").alias("competitor_count"),
            F.array_join(F.array_sort(F.collect_list("competitor_name")), ", ").alias("competitors"),
        )
    )
    price = num("current_list_price")
    gap = (price - F.col("avg_competitor_price")) / F.nullif("avg_competitor_price", F.lit(0.0)) * 100
    chosen = products.filter(F.col("product_status").isin(*statuses))
    return (
        chosen.join(latest, key, "left")
        .join(market, key, "left")
        .select(
            "client_id", "product_sku", "product_name", "product_category", "product_family", "product_status", "launch_date",
            price.alias("current_list_price"),
            num("standard_cost").alias("standard_cost"),
            percent(money("current_list_price") - money("standard_cost"), "current_list_price").alias("gross_margin_pct"),
            "value_metric",
            "competitor_equivalent",
            "last_price_change_date",
            num("h.p").alias("previous_list_price"),
            num("h.c").alias("last_change_pct"),
            F.col("h.r").alias("change_reason"),
            "avg_competitor_price",
            "avg_feature_score",
            F.coalesce("competitor_count", F.lit(0)).alias("competitor_count"),
            "competitors",
            gap.alias("price_vs_market_pct"),
            F.coalesce(F.col("avg_competitor_price") * (F.lit(0.9) + F.lit(0.2) * F.coalesce("avg_feature_score", F.lit(0.5))), price).alias("suggested_price"),
            F.when(gap > 5, "Premium").when(gap < -5, "Underpriced").otherwise("At Market").alias("market_position"),
        )
    )


def promotion_roi(promotions: DataFrame, revenue: DataFrame) -> DataFrame:
    """Revenue inside each promotion window against the equally long window just before it.

    Revenue is summed per SKU and day first, so a SKU with most of the sales is one row per day. See
    ``within`` for the interval join.
    """
    days = F.datediff("promotion_end_date", "promotion_start_date") + 1
    # Promotions without both dates or a SKU match nothing and keep zeros.
    windows = promotions.select(
        "client_id", "promotion_id", "product_sku", "promotion_start_date", "promotion_end_date",
        F.date_add("promotion_start_date", -days).alias("first"),
    ).filter(days > 0)
    daily = revenue.groupBy("client_id", "product_sku", F.col("transaction_date").alias("day")).agg(
        total("revenue").alias("rev"), F.count(F.lit(1)).alias("n")
    )
    inside = F.col("day") >= F.col("promotion_start_date")
    zero = money(F.lit(0))
    sums = (
        within(daily, windows, ["client_id", "product_sku"], "day", "first", "promotion_end_date")
        .groupBy("client_id", "promotion_id")
        .agg(
            F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n"),
            F.sum(F.when(inside, F.col("rev")).otherwise(zero)).alias("during"),
            F.sum(F.when(~inside, F.col("rev")).otherwise(zero)).alias("before"),
        )
    )
    during, before = F.coalesce("during", zero), F.coalesce("before", zero)
    lift = during - before
    cost = money("promotional_cost")
    roi = percent(lift - cost, cost)
    return promotions.join(sums, ["client_id", "promotion_id"], "left").select(
        "client_id", "promotion_id", "product_sku", "promotion_type", "promotion_start_date", "promotion_end_date",
        days.alias("promo_duration_days"),
        num("promotional_price").alias("promotional_price"),
        num("regular_price").alias("regular_price"),
        percent(money("regular_price") - money("promotional_price"), "regular_price").alias("discount_depth_pct"),
        num(cost).alias("promotional_cost"),
        "target_segment", "promotion_channel",
        F.coalesce("n", F.lit(0)).alias("promo_txn_count"),
        num(during).alias("promo_revenue"),
        num(before).alias("baseline_revenue"),
        num(lift).alias("revenue_lift"),
        roi.alias("roi_pct"),
        F.when(lift < 0, "Below Baseline").when(roi >= 100, "High Performer").otherwise("Positive").alias("performance_band"),
    )
