"""Registered roll-ups, filters and the table builder, with their SQL."""

from __future__ import annotations

from ..plans import filters, gold, rollups
from .bindings import Bindings
from .oracle import as_int, dbl, fixed, pct, ratio, statement
from .registry import Query, plain

# Segments of the driver's customers.
DRIVER_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def on_view(name: str, fn, *args, **kwargs) -> Query:
    return lambda spark, folder: plain(fn(gold.view(name, Bindings(spark, folder).table), *args, **kwargs))


def on_table(name: str, fn) -> Query:
    return lambda spark, folder: plain(fn(Bindings(spark, folder).table(name)))


def _filtered_trend(spark, folder):
    b = Bindings(spark, folder)
    facts = filters.filter_revenue(
        b.fact_revenue, b.dim_customer, segments=["BUILDING", "MACHINERY"], regions=[f"NATION_{i}" for i in range(0, 25, 2)], period="Last 12mo"
    )
    return plain(gold.view("revenue_trend", b.table, overrides={"fact_revenue": facts}))


def _ytd_geo(spark, folder):
    b = Bindings(spark, folder)
    facts = filters.filter_revenue(b.fact_revenue, b.dim_customer, period="YTD")
    return plain(gold.view("geo_pricing", b.table, overrides={"fact_revenue": facts}))


def _tenant(spark, folder):
    return plain(gold.read_view("price_band", Bindings(spark, folder).table, "ASIA"))


def _builder(spark, folder):
    view = gold.view("customer_profitability", Bindings(spark, folder).table)
    return filters.build_table(view, ["client_id", "segment", "customer_id", "revenue"])


def _heatmap(cohorts):
    return rollups.cohort_heatmap(rollups.cohort_matrix(cohorts))


QUERIES: dict[str, Query] = {
    "waterfall_bars": on_view("waterfall", rollups.waterfall_bars),
    "revenue_at_risk": on_view("churn_risk", rollups.revenue_at_risk),
    "opportunity_totals": on_view("opportunities", rollups.opportunity_totals),
    "client_tier": on_table("clients", rollups.tier),
    "profitable_share": on_view("customer_profitability", rollups.profitable_share),
    "margin_deciles": on_view("customer_profitability", rollups.margin_deciles),
    "team_summary": on_view("deal_scorecard", rollups.team_summary),
    "pareto_split": on_view("sku_pareto", rollups.pareto_split),
    "geo_extremes": on_view("geo_pricing", rollups.geo_extremes),
    "band_segment_pivot": on_view("price_band", rollups.segment_pivot, "price_band", "segment", DRIVER_SEGMENTS),
    "cycle_segment_pivot": on_view("deal_velocity", rollups.segment_pivot, "cycle_bucket", "customer_segment", DRIVER_SEGMENTS),
    "outcome_counts": on_view("win_loss", rollups.outcome_counts),
    "top_competitors": on_view("win_loss", rollups.top_competitors),
    "segment_cycle": on_view("deal_velocity", rollups.segment_cycle),
    "governance_bands": on_view("discount_governance", rollups.governance_bands),
    "governance_totals": on_view("discount_governance", rollups.governance_totals),
    "cohort_matrix": on_view("cohort_revenue", rollups.cohort_matrix),
    "cohort_heatmap": on_view("cohort_revenue", _heatmap),
    "rep_top": on_view("sales_rep_perf", rollups.rep_top),
    "size_outcome_pivot": on_view("deal_size_dist", rollups.size_outcome_pivot),
    "large_deal_share": on_view("deal_size_dist", rollups.large_deal_share),
    "competitor_list": on_view("competitive_intel", rollups.competitor_list),
    "rebate_by_customer": on_view("rebate_analysis", rollups.rebate_by_customer),
    "rebate_totals": on_view("rebate_analysis", rollups.rebate_totals),
    "serve_cost_top": on_view("cost_to_serve", rollups.serve_cost_top),
    "serve_cost_by_segment": on_view("cost_to_serve", rollups.serve_cost_by_segment),
    "promotion_totals": on_view("promotion_roi", rollups.promotion_totals),
    "portfolio": on_table("clients", rollups.portfolio),
    "readiness": on_table("clients", rollups.readiness),
    "filtered_trend": _filtered_trend,
    "ytd_geo_pricing": _ytd_geo,
    "tenant_view": _tenant,
    "table_builder": _builder,
}

_STEPS = rollups.WATERFALL_ORDER


def _bars() -> str:
    """Every bar written out: its base is the last anchor plus the steps since."""
    parts, since = [], []
    for i, (name, column, sign) in enumerate(_STEPS):
        value = f"CAST({column} AS DOUBLE) * {sign}"
        if name in rollups.WATERFALL_ANCHORS:
            since, base = [value], "0"
        else:
            since.append(value)
            base = " + ".join(f"({v})" for v in since)
        parts.append(f"SELECT client_id, {i} AS step, '{name}' AS name, {value} AS value, CAST({base} AS DOUBLE) AS base, abs({value}) AS height FROM v_waterfall")
    return "\nUNION ALL\n".join(parts)


def _pivot(view: str, band: str, column: str, labels, extra: str = "") -> str:
    cells = ", ".join(f"CAST(coalesce(sum(deal_count) FILTER ({column} = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in labels)
    return f"SELECT client_id, {band}{extra}, {cells} FROM {view} GROUP BY client_id, {band}{extra}"


_MONTH_FACTS = """
SELECT f.* FROM fact_revenue f JOIN (SELECT client_id, max(transaction_date) AS last FROM fact_revenue GROUP BY client_id) l
    ON f.client_id = l.client_id WHERE transaction_date >= {start}"""
_MATRIX = """
SELECT c.client_id, c.cohort_month, m.rev_month, cohort_rank, month_rank, coalesce(revenue, 0) AS revenue, coalesce(revenue, 0) / peak AS intensity
FROM (SELECT client_id, cohort_month, row_number() OVER (PARTITION BY client_id ORDER BY cohort_month DESC) AS cohort_rank
      FROM (SELECT DISTINCT client_id, cohort_month FROM v_cohort_revenue)) c
JOIN (SELECT client_id, rev_month, row_number() OVER (PARTITION BY client_id ORDER BY rev_month) AS month_rank
      FROM (SELECT DISTINCT client_id, rev_month FROM v_cohort_revenue)) m ON m.client_id = c.client_id
JOIN (SELECT client_id, max(revenue) AS peak FROM v_cohort_revenue GROUP BY client_id) p ON p.client_id = c.client_id
LEFT JOIN v_cohort_revenue v ON v.client_id = c.client_id AND v.cohort_month = c.cohort_month AND v.rev_month = m.rev_month
WHERE cohort_rank <= 8 AND month_rank <= 12"""

_SQL: dict[str, str] = {
    "waterfall_bars": _bars(),
    "revenue_at_risk": f"""
        SELECT client_id, {fixed('CASE WHEN risk_score > 70 THEN revenue ELSE 0 END')} AS revenue_at_risk,
            {fixed('CASE WHEN risk_score < 30 THEN revenue ELSE 0 END')} AS revenue_secured,
            count(*) FILTER (risk_score > 70) AS high_risk, count(*) FILTER (risk_score < 30) AS low_risk,
            {fixed('risk_score')} / count(*) AS avg_score FROM v_churn_risk GROUP BY client_id""",
    "opportunity_totals": f"""
        SELECT client_id, t AS total_impact, n AS high_confidence_count, h AS high_confidence_value, scenario, t * capture AS captured
        FROM (SELECT client_id, {fixed('impact_mid')} AS t, count(*) FILTER (confidence = 'High') AS n,
                {fixed("CASE WHEN confidence = 'High' THEN impact_mid ELSE 0 END")} AS h FROM v_opportunities GROUP BY client_id),
            (VALUES ('Conservative', 0.3::DOUBLE), ('Moderate', 0.5::DOUBLE), ('Ambitious', 0.7::DOUBLE)) s(scenario, capture)""",
    "client_tier": """
        SELECT client_id, CASE WHEN gold_status = 'complete' THEN 'Gold' WHEN silver_status = 'complete' THEN 'Silver' ELSE 'Bronze' END AS tier,
            total_records FROM clients""",
    "profitable_share": f"""
        SELECT client_id, {pct('count(*) FILTER (margin >= 0)', 'count(*)')} AS profitable_pct,
            {pct('count(*) - count(*) FILTER (margin >= 0)', 'count(*)')} AS unprofitable_pct, max(margin) AS max_margin, min(margin) AS min_margin
        FROM v_customer_profitability GROUP BY client_id""",
    "margin_deciles": """
        SELECT client_id, quantile_disc(margin, 0.1) AS bottom_decile_margin, quantile_disc(margin, 0.9) AS top_decile_margin
        FROM v_customer_profitability GROUP BY client_id""",
    "team_summary": f"""
        SELECT client_id, {fixed('win_rate')} / count(*) AS avg_win_rate, {fixed('avg_discount')} / count(*) AS avg_discount,
            {fixed('revenue')} AS total_revenue, arg_max(rep, revenue) AS top_rep, max(win_rate) AS best_win_rate, min(win_rate) AS worst_win_rate
        FROM v_deal_scorecard GROUP BY client_id""",
    "pareto_split": """
        SELECT client_id, count(*) FILTER (cum_pct <= 80) AS head_skus, count(*) FILTER (cum_pct > 80) AS tail_skus,
            (SELECT sku FROM v_sku_pareto q WHERE q.client_id = p.client_id ORDER BY revenue DESC, sku LIMIT 1) AS top_sku
        FROM v_sku_pareto p GROUP BY client_id""",
    "geo_extremes": """
        SELECT client_id, arg_max(region, avg_price) AS highest_region, arg_min(region, avg_price) AS lowest_region,
            max(variance) - min(variance) AS variance_spread FROM v_geo_pricing GROUP BY client_id""",
    "band_segment_pivot": _pivot("v_price_band", "price_band", "segment", DRIVER_SEGMENTS),
    "cycle_segment_pivot": _pivot("v_deal_velocity", "cycle_bucket", "customer_segment", DRIVER_SEGMENTS),
    "outcome_counts": """
        SELECT client_id, deal_outcome AS label, count(*) AS deals, 'outcome' AS kind FROM deals GROUP BY client_id, deal_outcome
        UNION ALL SELECT client_id, loss_reason, count(*), 'loss_reason' FROM deals WHERE deal_outcome = 'Lost' GROUP BY client_id, loss_reason
        UNION ALL SELECT client_id, competitor_cited, count(*), 'competitor' FROM deals WHERE competitor_cited IS NOT NULL GROUP BY client_id, competitor_cited""",
    "top_competitors": """
        SELECT client_id, competitor_cited AS competitor, count(*) AS deals,
            row_number() OVER (PARTITION BY client_id ORDER BY count(*) DESC, competitor_cited) AS rank
        FROM deals WHERE competitor_cited IS NOT NULL GROUP BY client_id, competitor_cited
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY count(*) DESC, competitor_cited) <= 3""",
    "segment_cycle": f"""
        SELECT client_id, customer_segment, {fixed('avg_days')} / count(*) AS avg_days,
            {fixed('avg_days * deal_count')} / sum(deal_count) AS weighted_avg_days FROM v_deal_velocity GROUP BY client_id, customer_segment""",
    "governance_bands": """
        SELECT client_id, discount_band, band_order, required_approval, CAST(sum(deal_count) AS BIGINT) AS deal_count,
            CAST(sum(override_count) AS BIGINT) AS override_count FROM v_discount_governance GROUP BY ALL""",
    "governance_totals": f"""
        SELECT client_id, count(*) AS total_deals, count(*) FILTER (discount_pct >= 15) AS director_plus,
            {pct('count(*) FILTER (discount_pct >= 15)', 'count(*)')} AS director_plus_pct, count(*) FILTER (override_flag) AS total_overrides
        FROM deals GROUP BY client_id""",
    "cohort_matrix": _MATRIX,
    "cohort_heatmap": "SELECT client_id, cohort_month, "
        + ", ".join(f"max(revenue) FILTER (month_rank = {i + 1}) AS \"M{i + 1}\"" for i in range(12))
        + f" FROM ({_MATRIX}) GROUP BY client_id, cohort_month",
    "rep_top": """
        SELECT * FROM (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY bookings DESC, rep) AS rank, rep, bookings, quota_attainment,
            CASE WHEN quota_attainment < 80 THEN 'below 80' WHEN quota_attainment < 100 THEN '80 to 100' ELSE '100 and above' END AS quota_band
            FROM v_sales_rep_perf) WHERE rank <= 10""",
    "size_outcome_pivot": _pivot("v_deal_size_dist", "size_band", "deal_outcome", ("Won", "Lost", "No Decision"), ", band_order"),
    "large_deal_share": f"""
        SELECT client_id, {dbl('coalesce(sum(deal_value) FILTER (deal_value >= 25000), 0)')} AS large_value, {dbl('sum(deal_value)')} AS total_value,
            {pct('coalesce(sum(deal_value) FILTER (deal_value >= 25000), 0)', 'sum(deal_value)')} AS large_value_pct FROM deals GROUP BY client_id""",
    "competitor_list": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY competitor_name, own_product_sku, price_type, confidence_level) AS rank
            FROM v_competitive_intel) WHERE rank <= 10""",
    "rebate_by_customer": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY accrued DESC, customer_id) AS rank FROM (
            SELECT client_id, customer_id, customer_name, {fixed('total_accrued')} AS accrued, {fixed('total_claimed')} AS claimed,
                {fixed('total_paid')} AS paid, {fixed('leakage')} AS leakage, count(*) AS rows FROM v_rebate_analysis GROUP BY ALL)) WHERE rank <= 10""",
    "rebate_totals": f"""
        SELECT client_id, {dbl('sum(accrued_amount - paid_amount)')} AS total_leakage, {fixed('payout')} / count(payout) AS avg_payout_rate
        FROM (SELECT *, {pct('paid_amount', 'accrued_amount')} AS payout FROM rebates) GROUP BY client_id""",
    "serve_cost_top": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY total_cost DESC, customer_id) AS rank FROM (
            SELECT client_id, customer_id, customer_name, {fixed('total_cost_to_serve')} AS total_cost FROM v_cost_to_serve GROUP BY ALL)) WHERE rank <= 12""",
    "serve_cost_by_segment": f"""
        SELECT client_id, customer_segment, {fixed('total_cost_to_serve')} / count(*) AS avg_cost FROM v_cost_to_serve GROUP BY ALL""",
    "promotion_totals": f"""
        SELECT client_id, {fixed('revenue_lift')} AS total_lift, {fixed('promotional_cost')} AS total_cost,
            {pct(f"{fixed('revenue_lift')} - {fixed('promotional_cost')}", fixed('promotional_cost'))} AS overall_roi_pct,
            count(*) FILTER (performance_band <> 'Below Baseline') AS winners
        FROM v_promotion_roi WHERE promo_revenue > 0 GROUP BY client_id""",
    "portfolio": """
        SELECT count(*) AS clients, count(*) FILTER (silver_status = 'complete') AS ready_clients, CAST(sum(total_records) AS BIGINT) AS total_records FROM clients""",
    "readiness": """
        SELECT client_id, readiness_nda::INT + readiness_data_dict::INT + readiness_contact::INT + readiness_goals::INT AS done, 4 AS of,
            coalesce(NULLIF(concat_ws(', ', CASE WHEN NOT readiness_nda THEN 'NDA' END, CASE WHEN NOT readiness_data_dict THEN 'Data Dict' END,
                CASE WHEN NOT readiness_contact THEN 'Contact' END, CASE WHEN NOT readiness_goals THEN 'Goals' END), ''), 'All clear') AS missing,
            total_records FROM clients""",
    "filtered_trend": f"""
        SELECT client_id, strftime(transaction_date, '%Y-%m') AS month, strftime(transaction_date, '%Y-%m-01') AS month_date,
            {dbl('sum(revenue)')} / 1000 AS revenue, {pct('sum(revenue) - sum(cogs)', 'sum(revenue)')} AS margin
        FROM ({_MONTH_FACTS.format(start='last - INTERVAL 12 MONTH + INTERVAL 1 DAY')}) f
        WHERE EXISTS (SELECT 1 FROM dim_customer c WHERE c.client_id = f.client_id AND c.customer_id = f.customer_id
            AND customer_segment IN ('BUILDING', 'MACHINERY') AND CAST(replace(geography_primary, 'NATION_', '') AS INTEGER) % 2 = 0)
        GROUP BY ALL""",
    "ytd_geo_pricing": f"""
        SELECT client_id, geography AS region, {ratio('r', 'q')} AS avg_price, {ratio('ar', 'aq')} AS national,
            ({ratio('r', 'q')} - {ratio('ar', 'aq')}) / {ratio('ar', 'aq')} * 100 AS variance, {dbl('r')} AS revenue
        FROM (SELECT client_id, geography, sum(revenue) AS r, sum(quantity) AS q, sum(sum(revenue)) OVER (PARTITION BY client_id) AS ar,
                sum(sum(quantity)) OVER (PARTITION BY client_id) AS aq
              FROM ({_MONTH_FACTS.format(start="date_trunc('year', last)")}) GROUP BY client_id, geography)""",
    "tenant_view": "SELECT * FROM v_price_band WHERE client_id = 'ASIA'",
    "table_builder": "SELECT client_id, segment, customer_id, revenue FROM v_customer_profitability",
}
_INTEGERS = {
    "top_competitors": ("rank",), "rep_top": ("rank",), "competitor_list": ("rank",), "rebate_by_customer": ("rank",),
    "serve_cost_top": ("rank",), "cohort_matrix": ("cohort_rank", "month_rank"),
}
for _name, _columns in _INTEGERS.items():
    _SQL[_name] = as_int(_SQL[_name], *_columns)
SQL = {name: statement(sql) for name, sql in _SQL.items()}
