"""Registered named analyses, with their SQL."""

from __future__ import annotations

from ..plans import named_analyses as n
from .bindings import Bindings
from .oracle import dbl, pct, ratio, statement
from .registry import Query, plain


def on(fn, *tables) -> Query:
    def run(spark, folder):
        b = Bindings(spark, folder)
        return plain(fn(*[b.table(t) for t in tables]))
    return run


QUERIES: dict[str, Query] = {
    "margin_bridge": on(n.margin_bridge, "fact_revenue"),
    "price_elasticity": on(n.price_elasticity, "fact_revenue"),
    "channel_conflict": on(n.channel_conflict, "fact_revenue"),
    "annual_escalation": on(n.annual_escalation, "fact_list_price_history"),
    "contract_leakage": on(n.contract_leakage, "fact_revenue", "dim_contract"),
    "price_corridor": on(n.price_corridor, "fact_revenue"),
}

_YEARS = "(SELECT client_id, year(transaction_date) AS yr, sum(revenue) AS r, sum(cogs) AS c FROM fact_revenue GROUP BY ALL)"

_SQL = {
    "margin_bridge": f"""
        SELECT b.client_id, CAST(b.yr AS VARCHAR) AS period, {dbl('a.r - a.c')} AS margin_before, {dbl('b.r - a.r')} AS revenue_effect,
            {dbl('a.c - b.c')} AS cost_effect, {dbl('b.r - b.c')} AS margin_after
        FROM {_YEARS} a JOIN {_YEARS} b ON a.client_id = b.client_id AND b.yr = a.yr + 1""",
    "price_elasticity": f"""
        SELECT client_id, product_sku, CASE WHEN max(p) > min(p) * 1.001::DOUBLE THEN round(regr_slope(ln(q), ln(p)), 4) + 0::DOUBLE END AS elasticity, count(*) AS months
        FROM (SELECT client_id, product_sku, {dbl('sum(quantity)')} AS q, {ratio('sum(revenue)', 'sum(quantity)')} AS p FROM fact_revenue
            GROUP BY client_id, product_sku, date_trunc('month', transaction_date) HAVING sum(revenue) > 0 AND sum(quantity) > 0) GROUP BY client_id, product_sku""",
    "channel_conflict": f"""
        SELECT client_id, product_sku, count(*) AS channels, min(p) AS lowest_price, max(p) AS highest_price, (max(p) - min(p)) / min(p) * 100 AS spread_pct
        FROM (SELECT client_id, product_sku, sales_channel, {ratio('sum(revenue)', 'sum(quantity)')} AS p FROM fact_revenue GROUP BY ALL)
        GROUP BY client_id, product_sku HAVING count(*) > 1""",
    "annual_escalation": f"""
        SELECT a.client_id, a.product_sku, CAST(a.effective_date AS VARCHAR) AS effective_date, {dbl('b.list_price')} AS price_before,
            {dbl('a.list_price')} AS price_after, {pct('a.list_price - b.list_price', 'b.list_price')} AS escalation_pct
        FROM price_history a JOIN price_history b ON a.client_id = b.client_id AND a.product_sku = b.product_sku AND a.effective_date > b.effective_date""",
    "contract_leakage": f"""
        SELECT f.client_id, 'CTR-' || f.customer_id AS contract_id, count(*) AS transactions, count(*) FILTER (invoice_price < contracted_price) AS below_contract,
            {dbl('sum(CASE WHEN invoice_price < contracted_price THEN (contracted_price - invoice_price) * quantity ELSE 0 END)')} AS leakage
        FROM fact_revenue f JOIN contracts c ON c.client_id = f.client_id AND c.customer_id = f.customer_id
            AND transaction_date BETWEEN contract_start_date AND contract_end_date GROUP BY ALL""",
    "price_corridor": f"""
        SELECT client_id, product_sku, {dbl('quantile_disc(invoice_price, 0.1)')} AS p10, {dbl('quantile_disc(invoice_price, 0.5)')} AS p50,
            {dbl('quantile_disc(invoice_price, 0.9)')} AS p90, count(*) AS transactions FROM fact_revenue GROUP BY ALL""",
}
SQL = {name: statement(sql) for name, sql in _SQL.items()}
