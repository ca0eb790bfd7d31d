"""The views by name, over any source of canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import deal_views as d
from . import market_views as m
from . import opportunities as o
from . import revenue_views as r

Loader = Callable[[str], DataFrame]

# View name -> function and the canonical tables it reads, in argument order.
VIEWS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "executive_summary": (r.executive_summary, ("fact_revenue", "clients")),
    "waterfall": (r.waterfall, ("fact_revenue",)),
    "revenue_trend": (r.revenue_trend, ("fact_revenue",)),
    "customer_profitability": (r.customer_profitability, ("fact_revenue", "dim_customer")),
    "sku_pareto": (r.sku_pareto, ("fact_revenue",)),
    "price_volume_mix": (r.price_volume_mix, ("fact_revenue",)),
    "deal_scorecard": (d.deal_scorecard, ("fact_deal_opportunity", "dim_sales_rep")),
    "churn_risk": (r.churn_risk, ("fact_revenue", "dim_customer", "fact_recurring_revenue")),
    "geo_pricing": (r.geo_pricing, ("fact_revenue",)),
    "opportunities": (o.opportunities, ("fact_revenue", "fact_deal_opportunity", "fact_rebate_incentive", "dim_customer", "fact_recurring_revenue")),
    "price_band": (d.price_band, ("fact_deal_opportunity",)),
    "win_loss": (d.win_loss, ("fact_deal_opportunity",)),
    "deal_velocity": (d.deal_velocity, ("fact_deal_opportunity", "dim_sales_rep")),
    "discount_governance": (d.discount_governance, ("fact_deal_opportunity",)),
    "cohort_revenue": (r.cohort_revenue, ("fact_revenue", "dim_customer")),
    "sales_rep_perf": (d.sales_rep_perf, ("fact_deal_opportunity", "dim_sales_rep")),
    "deal_size_dist": (d.deal_size_dist, ("fact_deal_opportunity",)),
    "competitive_intel": (m.competitive_intel, ("fact_competitive_intel", "dim_product")),
    "rebate_analysis": (m.rebate_analysis, ("fact_rebate_incentive", "dim_customer")),
    "cost_to_serve": (m.cost_to_serve, ("fact_cost_to_serve", "dim_customer")),
    "new_product_pricing": (m.new_product_pricing, ("dim_product", "fact_list_price_history", "fact_competitive_intel")),
    "promotion_roi": (m.promotion_roi, ("dim_promotion", "fact_revenue")),
}

# Order in which a view is shown.
ORDER = {
    "revenue_trend": ("month_date",), "opportunities": ("priority",), "price_band": ("band_order",),
    "discount_governance": ("band_order",), "cohort_revenue": ("cohort_month", "rev_month"), "deal_size_dist": ("band_order",),
    "new_product_pricing": ("launch_date",), "promotion_roi": ("promotion_start_date",),
}


def view(name: str, load: Loader, client_id: str | None = None, overrides: dict[str, DataFrame] | None = None) -> DataFrame:
    """One view; with ``client_id`` every input is cut to that client before anything else.

    ``overrides`` replaces inputs by name, e.g. filtered facts.
    """
    fn, inputs = VIEWS[name]
    overrides = overrides or {}

    def source(key: str) -> DataFrame:
        if key.startswith("view:"):
            return view(key[5:], load, client_id, overrides)
        df = overrides[key] if key in overrides else load(key)
        return df if client_id is None else df.filter(F.col("client_id") == client_id)

    return fn(*[source(k) for k in inputs])


def read_view(name: str, load: Loader, client_id: str, limit: int | None = None) -> DataFrame:
    """One client's view in display order, optionally cut to the first rows."""
    out = view(name, load, client_id)
    if name in ORDER:
        out = out.orderBy(*ORDER[name])
    return out if limit is None else out.limit(limit)


def single_row(df: DataFrame) -> DataFrame:
    """The frame itself, failing when it holds more than one row; two rows at most reach the driver."""
    if len(df.limit(2).collect()) > 1:
        raise ValueError("expected at most one row")
    return df


def register_views(spark: SparkSession, load: Loader, prefix: str = "vw_") -> list[str]:
    """Temporary SQL views ``vw_<name>`` over all clients."""
    names = []
    for name in VIEWS:
        view(name, load).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
