"""SQL for the registered queries, written from the definitions and run by DuckDB on the same files."""

from __future__ import annotations

import re

# Canonical tables and shared intermediate results; a query gets the ones it names, with all they need.
CTES: dict[str, str] = {
    "home": """
        SELECT c_custkey, c_name, c_mktsegment, n_name, r_name, r_regionkey
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "home_parts": "SELECT part.*, r_name FROM part JOIN region ON p_partkey % 5 = r_regionkey",
    "fact_revenue": """
        SELECT t.*,
            CASE WHEN sales_channel = 'N' THEN CAST(gross * 0.01 AS DECIMAL(18,4)) ELSE 0 END AS prompt_pay_discount,
            CASE WHEN sales_channel = 'R' THEN CAST(gross * 0.02 AS DECIMAL(18,4)) ELSE 0 END AS freight_absorption,
            CASE WHEN linenumber % 2 = 0 THEN CAST(gross * 0.01 AS DECIMAL(18,4)) ELSE 0 END AS co_op_marketing,
            CASE WHEN sales_channel = 'R' AND linestatus = 'F' THEN CAST(gross * 0.05 AS DECIMAL(18,4)) ELSE 0 END AS credit_memo_amount,
            CAST(gross * 0.60 AS DECIMAL(18,4)) AS cogs,
            CAST(gross * discount AS DECIMAL(18,4)) AS volume_discount,
            CAST(gross * tax AS DECIMAL(18,4)) AS rebate_amount,
            CAST(gross * (1 - discount) AS DECIMAL(18,4)) AS revenue,
            CAST(list_price * (1 - discount) AS DECIMAL(18,4)) AS invoice_price
        FROM (SELECT l_orderkey || '-' || l_linenumber AS transaction_id, r_name AS client_id,
                CAST(l_shipdate AS DATE) AS transaction_date, o_custkey AS customer_id, l_partkey AS product_sku,
                l_suppkey AS sales_rep_id, l_returnflag AS sales_channel, l_linestatus AS linestatus,
                l_linenumber AS linenumber, n_name AS geography,
                CAST(l_quantity AS DECIMAL(10,0)) AS quantity, CAST(p_retailprice AS DECIMAL(10,2)) AS list_price,
                CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(l_tax AS DECIMAL(4,2)) AS tax,
                CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(l_quantity AS DECIMAL(10,0)) AS DECIMAL(18,2)) AS gross
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
              JOIN home ON o_custkey = c_custkey) t""",
    "deals": """
        SELECT CAST(o_orderkey AS VARCHAR) AS deal_id, r_name AS client_id, o_custkey AS customer_id,
            CASE o_orderstatus WHEN 'F' THEN 'Won' WHEN 'P' THEN 'Lost' ELSE 'No Decision' END AS deal_outcome,
            CAST(o_orderdate AS DATE) AS deal_close_date,
            CAST(o_totalprice AS DECIMAL(18,4)) AS deal_value,
            CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CASE o_orderkey % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 0.010
                WHEN 2 THEN 0.050 WHEN 3 THEN 0.200 ELSE 1.000 END AS DECIMAL(18,4)) AS final_price,
            CAST(o_orderkey % 30 AS DECIMAL(18,4)) AS discount_pct,
            CAST(o_orderkey * 7 % 150 AS INTEGER) AS sales_cycle_days,
            o_custkey % 20 AS sales_rep_id, c_mktsegment AS customer_segment,
            CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS loss_reason,
            CASE WHEN o_orderstatus = 'P' THEN 'Competitor_' || (o_custkey % 5) END AS competitor_cited,
            (o_orderkey % 30 > 20 AND o_orderkey % 2 = 0) AS override_flag
        FROM orders JOIN home ON o_custkey = c_custkey""",
    "dim_customer": """
        SELECT r_name AS client_id, c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment,
            n_name AS geography_primary FROM home""",
    "dim_product": """
        SELECT r_name AS client_id, p_partkey AS product_sku, p_name AS product_name, p_type AS product_category,
            p_brand AS product_family,
            CASE p_size % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Beta' ELSE 'Pipeline' END AS product_status,
            DATE '2000-01-01' + p_size AS launch_date,
            CAST(p_retailprice AS DECIMAL(10,2)) AS current_list_price,
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.60 AS DECIMAL(18,4)) AS standard_cost,
            'unit' AS value_metric, 'Rival ' || p_brand AS competitor_equivalent
        FROM home_parts""",
    "dim_sales_rep": """
        SELECT DISTINCT r_name AS client_id, c_custkey % 20 AS sales_rep_id,
            'Rep Number' || (c_custkey % 20) AS sales_rep_name, 'Territory ' || (c_custkey % 20 % 4) AS territory,
            CASE WHEN c_custkey % 2 = 0 THEN 'Enterprise' ELSE 'SMB' END AS segment_coverage,
            CAST(c_custkey % 20 + 6 AS INTEGER) AS tenure_months,
            CAST((c_custkey % 20 + 1) * 1000000 AS DECIMAL(18,4)) AS quota
        FROM home""",
    "rebates": """
        SELECT client_id, customer_id, period,
            CASE customer_id % 4 WHEN 0 THEN 'volume' WHEN 1 THEN 'growth' WHEN 2 THEN 'loyalty' ELSE 'promotional' END AS rebate_type,
            accrued AS accrued_amount, CAST(accrued * 0.95 AS DECIMAL(18,4)) AS claimed_amount,
            CAST(accrued * CASE customer_id % 3 WHEN 0 THEN 0.80 WHEN 1 THEN 0.81 ELSE 0.82 END AS DECIMAL(18,4)) AS paid_amount
        FROM (SELECT client_id, customer_id, year(transaction_date) || '-Q' || quarter(transaction_date) AS period,
                CAST(sum(rebate_amount) AS DECIMAL(18,4)) AS accrued FROM fact_revenue GROUP BY ALL)""",
    "serve_costs": """
        SELECT client_id, customer_id, period,
            CAST(c * 0.05 AS DECIMAL(18,4)) AS service_cost, CAST(c * 0.04 AS DECIMAL(18,4)) AS logistics_cost,
            CAST(c * 0.02 AS DECIMAL(18,4)) AS returns_credits_cost, CAST(c * 0.03 AS DECIMAL(18,4)) AS intermediary_cost,
            CASE WHEN customer_id % 7 <> 0 THEN CAST(c * 0.01 AS DECIMAL(18,4)) END AS customization_cost,
            CAST(c * 0.01 AS DECIMAL(18,4)) AS payment_terms_cost, CAST(c * 0.06 AS DECIMAL(18,4)) AS sales_coverage_cost,
            n AS order_frequency, CAST(r AS DOUBLE) / n AS avg_order_size
        FROM (SELECT client_id, customer_id, year(transaction_date) || '-Q' || quarter(transaction_date) AS period,
                CAST(sum(cogs) AS DECIMAL(18,4)) AS c, sum(revenue) AS r, count(*) AS n FROM fact_revenue GROUP BY ALL)""",
    "price_history": """
        SELECT r_name AS client_id, p_partkey AS product_sku, DATE '1999-01-01' AS effective_date,
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.95 AS DECIMAL(18,4)) AS list_price,
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.90 AS DECIMAL(18,4)) AS previous_list_price,
            5.5556 AS change_pct, 'Inflation' AS change_reason FROM home_parts
        UNION ALL
        SELECT r_name, p_partkey, DATE '2000-01-01', CAST(p_retailprice AS DECIMAL(18,4)),
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.95 AS DECIMAL(18,4)), 5.2632, 'Annual review' FROM home_parts""",
    "promotions": """
        SELECT 'PROMO-' || p_partkey AS promotion_id, r_name AS client_id, p_partkey AS product_sku,
            CASE WHEN p_size % 2 = 0 THEN 'volume_deal' ELSE 'price_cut' END AS promotion_type,
            DATE '1998-01-01' + CAST(p_partkey % 365 AS INTEGER) AS promotion_start_date,
            DATE '1998-01-01' + CAST(p_partkey % 365 + 89 AS INTEGER) AS promotion_end_date,
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.85 AS DECIMAL(18,4)) AS promotional_price,
            CAST(p_retailprice AS DECIMAL(18,4)) AS regular_price,
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 2.50 AS DECIMAL(18,4)) AS promotional_cost,
            'All' AS target_segment, CASE WHEN p_size % 2 = 0 THEN 'online' ELSE 'retail' END AS promotion_channel
        FROM home_parts""",
    "intel": """
        SELECT r_name AS client_id, 'Competitor_' || (k % 3) AS competitor_name, p_partkey AS own_product_sku,
            CAST(CAST(p_retailprice AS DECIMAL(10,2)) * (CASE k % 3 WHEN 0 THEN 0.90 WHEN 1 THEN 1.00 ELSE 1.15 END
                - CASE WHEN k >= 3 THEN 0.01 ELSE 0.00 END) AS DECIMAL(18,4)) AS competitor_price,
            CASE WHEN k >= 3 THEN 'street' ELSE 'list' END AS price_type,
            CASE WHEN k % 3 = 0 THEN 'High' ELSE 'Medium' END AS confidence_level,
            'Enterprise' AS market_segment, 'National' AS geography,
            CAST(p_size * 0.02 AS DECIMAL(18,4)) AS feature_comparison_score
        FROM home_parts, range(6) t(k)""",
    "recurring": """
        SELECT r_name AS client_id, user_id AS customer_id, CAST(count(*) % 11 AS DOUBLE) AS nps_score
        FROM events JOIN home ON user_id = c_custkey GROUP BY ALL""",
    "contracts": """
        SELECT r_name AS client_id, c_custkey AS customer_id,
            DATE '1996-01-01' + CAST(c_custkey % 365 AS INTEGER) AS contract_start_date,
            DATE '1999-01-01' + CAST(c_custkey % 365 AS INTEGER) AS contract_end_date,
            CAST(c_custkey % 100 + 900 AS DECIMAL(18,4)) AS contracted_price FROM home""",
    "clients": """
        SELECT r_name AS client_id, 'Client ' || r_name AS client_name, 'Distribution' AS industry,
            CASE WHEN r_regionkey % 2 = 0 THEN 'complete' ELSE 'pending' END AS silver_status,
            CASE WHEN r_regionkey = 0 THEN 'complete' ELSE 'pending' END AS gold_status,
            count(*) AS total_records, '2024-01-31' AS last_run_at,
            CASE WHEN r_regionkey < 3 THEN 'A' ELSE 'B' END AS data_quality_grade,
            r_regionkey % 2 = 0 AS readiness_nda, r_regionkey % 3 = 0 AS readiness_data_dict,
            r_regionkey > 1 AS readiness_contact, true AS readiness_goals
        FROM home GROUP BY r_name, r_regionkey""",
}


def define(name: str, sql: str) -> None:
    """Make a view's SQL usable by name in later statements."""
    CTES[name] = sql


def statement(body: str) -> str:
    """Put the needed CTEs in front of ``body``."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    return f"WITH {head}\n{body.strip()}"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"({dbl(a)} / NULLIF({dbl(b)}, 0))"


def pct(a: str, b: str) -> str:
    return f"({ratio(a, b)} * 100)"


def fixed(expr: str) -> str:
    """Sum of doubles as integer millionths."""
    return f"(CAST(sum(CAST(floor(({expr}) * 1000000 + 0.5) AS HUGEINT)) AS DOUBLE) / 1000000)"


def as_int(sql: str, *columns: str) -> str:
    """The same rows with the columns as 32-bit integers, as Spark numbers them."""
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def avg(a: str) -> str:
    return ratio(f"sum({a})", f"count({a})")


def rounded(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,6)), {digits}) AS DOUBLE)"


def banded(value: str, edges: list[int], labels: list[str], closed_right: bool = False) -> tuple[str, str]:
    """CASE expressions for label and rank."""
    label, rank = f"CASE WHEN {value} IS NULL THEN NULL", f"CASE WHEN {value} IS NULL THEN NULL"
    for i, edge in enumerate(edges):
        op = "<=" if closed_right or i == len(edges) - 1 else "<"
        label += f" WHEN {value} {op} {edge} THEN '{labels[i]}'"
        rank += f" WHEN {value} {op} {edge} THEN {i + 1}"
    return label + f" ELSE '{labels[-1]}' END", rank + f" ELSE {len(labels)} END"


VIEWS: dict[str, str] = {}

_OFF = "rebate_amount + freight_absorption + co_op_marketing + credit_memo_amount + prompt_pay_discount"
VIEWS["executive_summary"] = f"""
SELECT c.client_id, client_name, industry, {dbl('sum(revenue)')} AS total_revenue,
    {pct('sum(revenue) - sum(cogs)', 'sum(revenue)')} AS avg_margin,
    count(DISTINCT customer_id) AS total_customers, count(DISTINCT product_sku) AS active_products,
    {pct('sum((list_price - invoice_price) * quantity)', 'sum(list_price * quantity)')} AS avg_discount,
    {dbl(f'sum({_OFF})')} AS total_leakage, gold_status, silver_status, last_run_at, data_quality_grade
FROM clients c LEFT JOIN fact_revenue f ON c.client_id = f.client_id
GROUP BY c.client_id, client_name, industry, gold_status, silver_status, last_run_at, data_quality_grade"""

_GROSS = "sum(list_price * quantity)"
_GIVEN = ("sum(volume_discount) + sum(prompt_pay_discount) + sum(rebate_amount) + sum(freight_absorption) + "
          "sum(co_op_marketing) + sum(credit_memo_amount)")
VIEWS["waterfall"] = f"""
SELECT client_id, CAST(100 AS DOUBLE) AS list_price_index,
    {pct('sum(volume_discount)', _GROSS)} AS volume_discount_pct, {pct('sum(prompt_pay_discount)', _GROSS)} AS prompt_pay_pct,
    {pct('sum(rebate_amount)', _GROSS)} AS rebate_pct, {pct('sum(freight_absorption)', _GROSS)} AS freight_pct,
    {pct('sum(co_op_marketing)', _GROSS)} AS coop_pct, {pct('sum(credit_memo_amount)', _GROSS)} AS credit_memo_pct,
    100 - {pct(_GIVEN, _GROSS)} AS invoice_price_index, {pct('sum(cogs)', _GROSS)} AS cogs_index,
    100 - {pct(_GIVEN + ' + sum(cogs)', _GROSS)} AS pocket_margin_index
FROM fact_revenue GROUP BY client_id"""

VIEWS["revenue_trend"] = f"""
SELECT client_id, strftime(m, '%Y-%m') AS month, CAST(m AS VARCHAR) AS month_date,
    {dbl('r')} / 1000 AS revenue, {pct('r - c', 'r')} AS margin
FROM (SELECT client_id, CAST(date_trunc('month', transaction_date) AS DATE) AS m, sum(revenue) AS r, sum(cogs) AS c
      FROM fact_revenue GROUP BY ALL)"""

VIEWS["customer_profitability"] = f"""
SELECT f.client_id, f.customer_id, customer_name AS name, {dbl('sum(revenue)')} / 1000 AS revenue,
    {pct('sum(revenue) - sum(cogs)', 'sum(revenue)')} AS margin, count(*) AS size, customer_segment AS segment
FROM fact_revenue f LEFT JOIN dim_customer c ON f.client_id = c.client_id AND f.customer_id = c.customer_id
GROUP BY f.client_id, f.customer_id, customer_name, customer_segment"""

VIEWS["sku_pareto"] = f"""
SELECT client_id, product_sku AS sku, {dbl('r')} / 1000 AS revenue,
    {pct('sum(r) OVER (PARTITION BY client_id ORDER BY r DESC, product_sku)', 'sum(r) OVER (PARTITION BY client_id)')} AS cum_pct
FROM (SELECT client_id, product_sku, sum(revenue) AS r FROM fact_revenue GROUP BY ALL)"""

# Full outer pairing of consecutive years per SKU; the effects follow their textbook definitions where exactness allows.
VIEWS["price_volume_mix"] = f"""
SELECT b.client_id, CAST(b.yr AS VARCHAR) AS period,
    {dbl('b.r')} - s.s AS price,
    ({dbl('b.q')} - {dbl('a.q')}) * {ratio('a.r', 'a.q')} AS volume_effect,
    s.s - {dbl('b.q')} * {ratio('a.r', 'a.q')} AS mix,
    {dbl('b.r')} - {dbl('a.r')} AS total
FROM (SELECT client_id, year(transaction_date) AS yr, sum(revenue) AS r, sum(quantity) AS q FROM fact_revenue GROUP BY ALL) a
JOIN (SELECT client_id, year(transaction_date) AS yr, sum(revenue) AS r, sum(quantity) AS q FROM fact_revenue GROUP BY ALL) b
    ON a.client_id = b.client_id AND b.yr = a.yr + 1
JOIN (SELECT y.client_id, y.yr,
          {fixed(f"coalesce({ratio('x.r', 'x.q')}, {ratio('y.r', 'y.q')}) * {dbl('y.q')}")} AS s
      FROM (SELECT client_id, product_sku, year(transaction_date) AS yr, sum(revenue) AS r, sum(quantity) AS q FROM fact_revenue GROUP BY ALL) y
      LEFT JOIN (SELECT client_id, product_sku, year(transaction_date) AS yr, sum(revenue) AS r, sum(quantity) AS q FROM fact_revenue GROUP BY ALL) x
          ON x.client_id = y.client_id AND x.product_sku = y.product_sku AND x.yr = y.yr - 1
      GROUP BY y.client_id, y.yr) s ON s.client_id = b.client_id AND s.yr = b.yr"""

_WON = "sum(CASE WHEN deal_outcome = 'Won' THEN {} ELSE 0 END)"
VIEWS["deal_scorecard"] = f"""
SELECT d.client_id, sales_rep_name AS rep, {pct("count(*) FILTER (deal_outcome = 'Won')", 'count(*)')} AS win_rate,
    {avg('discount_pct')} AS avg_discount, count(*) AS deals, {dbl(_WON.format('deal_value'))} AS revenue
FROM deals d LEFT JOIN dim_sales_rep r ON d.client_id = r.client_id AND d.sales_rep_id = r.sales_rep_id
GROUP BY d.client_id, d.sales_rep_id, sales_rep_name"""

VIEWS["churn_risk"] = f"""
SELECT t.client_id, t.customer_id, customer_name AS name, {dbl('rev')} / 1000 AS revenue,
    least({dbl('days')} / 180, 1) * 40
    + coalesce(least(greatest(-(recent - prior) / NULLIF(prior, 0), 0), 1), 0) * 40
    + coalesce(1 - least(greatest(nps_score, 0), 10) / 10, 0.5::DOUBLE) * 20 AS risk_score,
    CASE WHEN recent > prior THEN 'growing' WHEN recent < prior THEN 'declining' ELSE 'stable' END AS trend
FROM (SELECT f.client_id, f.customer_id, sum(revenue) AS rev, date_diff('day', max(transaction_date), any_value(today)) AS days,
          {dbl("coalesce(sum(revenue) FILTER (transaction_date >= date_trunc('month', today) - INTERVAL 2 MONTH), 0)")} AS recent,
          {dbl("coalesce(sum(revenue) FILTER (transaction_date >= date_trunc('month', today) - INTERVAL 5 MONTH AND transaction_date < date_trunc('month', today) - INTERVAL 2 MONTH), 0)")} AS prior
      FROM fact_revenue f JOIN (SELECT client_id, max(transaction_date) AS today FROM fact_revenue GROUP BY client_id) a
          ON f.client_id = a.client_id
      GROUP BY f.client_id, f.customer_id) t
LEFT JOIN dim_customer c ON c.client_id = t.client_id AND c.customer_id = t.customer_id
LEFT JOIN recurring u ON u.client_id = t.client_id AND u.customer_id = t.customer_id"""

VIEWS["geo_pricing"] = f"""
SELECT g.client_id, geography AS region, {ratio('r', 'q')} AS avg_price, national,
    ({ratio('r', 'q')} - national) / national * 100 AS variance, {dbl('r')} AS revenue
FROM (SELECT client_id, geography, sum(revenue) AS r, sum(quantity) AS q FROM fact_revenue GROUP BY ALL) g
JOIN (SELECT client_id, {ratio('sum(revenue)', 'sum(quantity)')} AS national FROM fact_revenue GROUP BY client_id) n
    ON g.client_id = n.client_id"""

define("v_churn", VIEWS["churn_risk"])
VIEWS["opportunities"] = f"""
SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY impact_mid DESC, type) AS priority FROM (
    SELECT client_id, 'Discount' AS type, 'Discount Effectiveness' AS analysis,
        {dbl('sum((discount_pct - 15) * deal_value)')} / 100 AS impact_mid, 'High' AS confidence,
        'Won deals discounted above policy' AS description
    FROM deals WHERE deal_outcome = 'Won' AND discount_pct > 15 GROUP BY client_id
    UNION ALL
    SELECT client_id, 'Margin', 'Customer Profitability', {dbl('-sum(m)')}, 'High', 'Customers sold below cost'
    FROM (SELECT client_id, customer_id, sum(revenue) - sum(cogs) AS m FROM fact_revenue GROUP BY ALL) WHERE m < 0 GROUP BY client_id
    UNION ALL
    SELECT client_id, 'Rebate', 'Rebate Optimization', {dbl('sum(accrued_amount - paid_amount)')}, 'Medium', 'Rebates accrued but not paid out'
    FROM rebates GROUP BY client_id
    UNION ALL
    SELECT g.client_id, 'Geography', 'Geographic Pricing', {fixed(f"national * {dbl('q')} - {dbl('r')}")}, 'Medium',
        'Regions priced below the national average'
    FROM (SELECT client_id, geography, sum(revenue) AS r, sum(quantity) AS q FROM fact_revenue GROUP BY ALL) g
    JOIN (SELECT client_id, {ratio('sum(revenue)', 'sum(quantity)')} AS national FROM fact_revenue GROUP BY client_id) n
        ON g.client_id = n.client_id
    WHERE ({ratio('r', 'q')} - national) / national * 100 < -0.5 GROUP BY g.client_id
    UNION ALL
    SELECT client_id, 'Retention', 'Churn Risk', {fixed('revenue * 1000 * 0.5::DOUBLE')}, 'Low',
        'Revenue of customers likely to leave'
    FROM v_churn WHERE risk_score > 70 GROUP BY client_id) WHERE impact_mid > 0"""

_PB = banded("final_price", [500, 2000, 10000, 50000], ["<$500", "$500–2K", "$2K–10K", "$10K–50K", ">$50K"])
VIEWS["price_band"] = f"""
SELECT client_id, {_PB[0]} AS price_band, {_PB[1]} AS band_order, customer_segment AS segment, count(*) AS deal_count,
    {dbl('sum(final_price)')} AS revenue, {avg('final_price')} AS avg_price, {avg('discount_pct')} AS avg_discount_pct
FROM deals GROUP BY ALL"""

VIEWS["win_loss"] = f"""
SELECT client_id, deal_outcome, CASE WHEN deal_outcome = 'Lost' THEN loss_reason END AS loss_reason,
    CASE WHEN deal_outcome = 'Lost' THEN competitor_cited END AS competitor, customer_segment, count(*) AS deal_count,
    {dbl('sum(deal_value)')} AS total_value, {avg('discount_pct')} AS avg_discount, {avg('sales_cycle_days')} AS avg_cycle_days
FROM deals GROUP BY ALL"""

_CB = banded("sales_cycle_days", [30, 60, 90, 120], ["0–30d", "31–60d", "61–90d", "91–120d", "120d+"], True)
VIEWS["deal_velocity"] = f"""
SELECT d.client_id, customer_segment, sales_rep_name AS rep, deal_outcome, {_CB[0]} AS cycle_bucket, count(*) AS deal_count,
    {rounded(avg('sales_cycle_days'), 1)} AS avg_days, {avg('deal_value')} AS avg_deal_value
FROM deals d LEFT JOIN dim_sales_rep r ON d.client_id = r.client_id AND d.sales_rep_id = r.sales_rep_id GROUP BY ALL"""

_DB = banded("discount_pct", [5, 10, 15, 20], ["<5%", "5–10%", "10–15%", "15–20%", ">20%"])
VIEWS["discount_governance"] = f"""
SELECT client_id, {_DB[0]} AS discount_band, {_DB[1]} AS band_order,
    CASE WHEN discount_pct < 10 THEN 'Self-Service' WHEN discount_pct < 15 THEN 'Manager' WHEN discount_pct <= 20 THEN 'Director'
        ELSE 'Executive' END AS required_approval,
    customer_segment, count(*) AS deal_count, count(*) FILTER (override_flag) AS override_count,
    {dbl('sum(deal_value)')} AS total_value, {avg('deal_value')} AS avg_deal_value
FROM deals GROUP BY ALL"""

VIEWS["cohort_revenue"] = """
SELECT client_id, strftime(first, '%Y-%m') AS cohort_month, strftime(transaction_date, '%Y-%m') AS rev_month,
    count(DISTINCT customer_id) AS active_customers, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue
FROM (SELECT *, min(transaction_date) OVER (PARTITION BY client_id, customer_id) AS first FROM fact_revenue)
GROUP BY client_id, strftime(first, '%Y-%m'), strftime(transaction_date, '%Y-%m')"""

VIEWS["sales_rep_perf"] = f"""
SELECT d.client_id, d.sales_rep_id, sales_rep_name AS rep, territory, segment_coverage, tenure_months, {dbl('quota')} AS quota,
    count(*) AS total_deals, count(*) FILTER (deal_outcome = 'Won') AS won_deals, count(*) FILTER (deal_outcome = 'Lost') AS lost_deals,
    {pct("count(*) FILTER (deal_outcome = 'Won')", 'count(*)')} AS win_rate, {dbl(_WON.format('deal_value'))} AS bookings,
    {pct(_WON.format('deal_value'), 'quota')} AS quota_attainment, {avg('discount_pct')} AS avg_discount,
    {ratio("sum(sales_cycle_days) FILTER (deal_outcome = 'Won')", "count(*) FILTER (deal_outcome = 'Won')")} AS avg_cycle_days_won
FROM deals d LEFT JOIN dim_sales_rep r ON d.client_id = r.client_id AND d.sales_rep_id = r.sales_rep_id
GROUP BY d.client_id, d.sales_rep_id, sales_rep_name, territory, segment_coverage, tenure_months, quota"""

_SB = banded("deal_value", [5000, 25000, 100000, 500000], ["<$5K", "$5K–25K", "$25K–100K", "$100K–500K", ">$500K"])
VIEWS["deal_size_dist"] = f"""
SELECT client_id, {_SB[0]} AS size_band, {_SB[1]} AS band_order, customer_segment, deal_outcome, count(*) AS deal_count,
    {dbl('sum(deal_value)')} AS total_value, {avg('discount_pct')} AS avg_discount, {avg('sales_cycle_days')} AS avg_cycle_days
FROM deals GROUP BY ALL"""

VIEWS["competitive_intel"] = f"""
SELECT i.client_id, competitor_name, own_product_sku, product_name AS own_product_name, product_category, market_segment, geography,
    price_type, {rounded(avg('competitor_price'), 2)} AS avg_competitor_price, count(*) AS observations,
    {avg('feature_comparison_score')} AS avg_feature_score, confidence_level
FROM intel i LEFT JOIN dim_product p ON p.client_id = i.client_id AND p.product_sku = i.own_product_sku GROUP BY ALL"""

VIEWS["rebate_analysis"] = f"""
SELECT r.client_id, customer_name, r.customer_id, customer_segment AS segment, rebate_type, period,
    CAST(round(sum(accrued_amount), 2) AS DOUBLE) AS total_accrued, CAST(round(sum(claimed_amount), 2) AS DOUBLE) AS total_claimed,
    CAST(round(sum(paid_amount), 2) AS DOUBLE) AS total_paid, {pct('sum(paid_amount)', 'sum(accrued_amount)')} AS payout_rate,
    {dbl('sum(accrued_amount) - sum(paid_amount)')} AS leakage
FROM rebates r LEFT JOIN dim_customer c ON c.client_id = r.client_id AND c.customer_id = r.customer_id GROUP BY ALL"""

_COSTS = ["service_cost", "logistics_cost", "returns_credits_cost", "intermediary_cost", "customization_cost",
          "payment_terms_cost", "sales_coverage_cost"]
VIEWS["cost_to_serve"] = f"""
SELECT s.client_id, customer_name, s.customer_id, customer_segment, geography_primary AS region, period,
    {', '.join(f'{dbl(c)} AS {c}' for c in _COSTS)},
    CAST(round({' + '.join(f'coalesce({c}, 0)' for c in _COSTS)}, 2) AS DOUBLE) AS total_cost_to_serve,
    order_frequency, avg_order_size
FROM serve_costs s LEFT JOIN dim_customer c ON c.client_id = s.client_id AND c.customer_id = s.customer_id"""

VIEWS["new_product_pricing"] = f"""
SELECT p.client_id, p.product_sku, product_name, product_category, product_family, product_status,
    CAST(launch_date AS VARCHAR) AS launch_date, {dbl('current_list_price')} AS current_list_price, {dbl('standard_cost')} AS standard_cost,
    {pct('current_list_price - standard_cost', 'current_list_price')} AS gross_margin_pct, value_metric, competitor_equivalent,
    CAST(effective_date AS VARCHAR) AS last_price_change_date, {dbl('previous_list_price')} AS previous_list_price,
    {dbl('change_pct')} AS last_change_pct, change_reason, mp AS avg_competitor_price, mf AS avg_feature_score,
    coalesce(n, 0) AS competitor_count, competitors,
    ({dbl('current_list_price')} - mp) / mp * 100 AS price_vs_market_pct,
    coalesce(mp * (0.9::DOUBLE + 0.2::DOUBLE * coalesce(mf, 0.5::DOUBLE)), {dbl('current_list_price')}) AS suggested_price,
    CASE WHEN ({dbl('current_list_price')} - mp) / mp * 100 > 5 THEN 'Premium'
        WHEN ({dbl('current_list_price')} - mp) / mp * 100 < -5 THEN 'Underpriced' ELSE 'At Market' END AS market_position
FROM dim_product p
LEFT JOIN (SELECT * FROM price_history QUALIFY row_number() OVER (PARTITION BY client_id, product_sku ORDER BY effective_date DESC) = 1) h
    ON h.client_id = p.client_id AND h.product_sku = p.product_sku
LEFT JOIN (SELECT client_id, own_product_sku, {avg('competitor_price')} AS mp, {avg('feature_comparison_score')} AS mf,
        count(DISTINCT competitor_name) AS n, string_agg(DISTINCT competitor_name, ', ' ORDER BY competitor_name) AS competitors
      FROM intel GROUP BY ALL) m ON m.client_id = p.client_id AND m.own_product_sku = p.product_sku
WHERE product_status IN ('Beta', 'Pipeline')"""

VIEWS["promotion_roi"] = f"""
SELECT client_id, promotion_id, product_sku, promotion_type, CAST(promotion_start_date AS VARCHAR) AS promotion_start_date,
    CAST(promotion_end_date AS VARCHAR) AS promotion_end_date,
    date_diff('day', promotion_start_date, promotion_end_date) + 1 AS promo_duration_days,
    {dbl('promotional_price')} AS promotional_price, {dbl('regular_price')} AS regular_price,
    {pct('regular_price - promotional_price', 'regular_price')} AS discount_depth_pct, {dbl('promotional_cost')} AS promotional_cost,
    target_segment, promotion_channel, n AS promo_txn_count, {dbl('during')} AS promo_revenue, {dbl('before')} AS baseline_revenue,
    {dbl('during - before')} AS revenue_lift, {pct('during - before - promotional_cost', 'promotional_cost')} AS roi_pct,
    CASE WHEN during < before THEN 'Below Baseline'
        WHEN {pct('during - before - promotional_cost', 'promotional_cost')} >= 100 THEN 'High Performer' ELSE 'Positive' END AS performance_band
FROM (SELECT p.*, count(f.revenue) FILTER (f.transaction_date >= promotion_start_date) AS n,
          coalesce(sum(f.revenue) FILTER (f.transaction_date >= promotion_start_date), 0) AS during,
          coalesce(sum(f.revenue) FILTER (f.transaction_date < promotion_start_date), 0) AS before
      FROM promotions p LEFT JOIN fact_revenue f ON f.client_id = p.client_id AND f.product_sku = p.product_sku
          AND f.transaction_date BETWEEN promotion_start_date - 90 AND promotion_end_date
      GROUP BY ALL)"""

VIEWS["opportunities"] = as_int(VIEWS["opportunities"], "priority")
VIEWS["promotion_roi"] = as_int(VIEWS["promotion_roi"], "promo_duration_days")

for _name, _sql in VIEWS.items():
    define(f"v_{_name}", _sql)
