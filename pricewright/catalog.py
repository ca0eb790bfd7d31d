"""The star schema: tables, keys, required columns, defaults, keywords and header aliases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """One canonical table. ``columns`` excludes ``client_id``, which every table carries."""

    name: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    columns: tuple[str, ...]
    keywords: tuple[str, ...]
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def generated_key(self) -> bool:
        return self.key == ("id",)

    @property
    def merge_key(self) -> tuple[str, ...]:
        """Always per client: two clients may use the same natural key."""
        return ("client_id", *self.key)

    def schema(self) -> T.StructType:
        names = (("id",) if self.generated_key else ()) + ("client_id", *self.columns)
        return T.StructType([T.StructField(n, column_type(n)) for n in names])


# The canonical tables with their key, required columns, columns, keywords and defaults.
_TABLES = [
    Table(
        "dim_customer", ("customer_id",), ("customer_id", "customer_name"),
        (
            "customer_id", "customer_name", "customer_segment", "customer_group", "customer_rollup", "industry",
            "sub_industry", "geography_primary", "customer_since_date", "annual_revenue_band", "account_owner_id",
            "payment_terms_contracted", "price_tier", "strategic_flag", "credit_score", "switching_cost_proxy",
            "member_count",
        ),
        ("customer", "account", "client dim", "buyers"),
    ),
    Table(
        "dim_product", ("product_sku",), ("product_sku", "product_name", "product_type"),
        (
            "product_sku", "product_name", "product_category", "product_family", "current_list_price",
            "standard_cost", "launch_date", "product_status", "unit_of_measure", "product_type", "value_metric",
            "competitor_equivalent", "cannibalization_group",
        ),
        ("product", "sku", "item", "catalog"),
        {"product_type": "physical_sku"},
    ),
    Table(
        "dim_sales_rep", ("sales_rep_id",), ("sales_rep_id", "sales_rep_name"),
        (
            "sales_rep_id", "sales_rep_name", "manager_id", "territory", "segment_coverage", "tenure_months",
            "comp_plan_type", "quota", "start_date",
        ),
        ("sales rep", "rep", "salesperson", "agent"),
    ),
    Table(
        "dim_contract", ("contract_id",), ("contract_id", "customer_id"),
        (
            "contract_id", "customer_id", "contract_start_date", "contract_end_date", "contracted_price",
            "contracted_payment_terms", "contracted_volume_commitment", "price_escalation_clause", "escalation_pct",
            "auto_renewal_flag", "sla_terms", "product_scope", "data_source_id",
        ),
        ("contract", "agreement", "sla"),
    ),
    Table(
        "dim_promotion", ("promotion_id",), ("promotion_id", "promotion_type"),
        (
            "promotion_id", "product_sku", "promotion_type", "promotion_start_date", "promotion_end_date",
            "promotional_price", "regular_price", "promotional_cost", "target_segment", "promotion_channel",
        ),
        ("promotion", "promo", "campaign", "discount program"),
    ),
    Table(
        "dim_intermediary", ("intermediary_id",), ("intermediary_id", "intermediary_name", "intermediary_type"),
        (
            "intermediary_id", "intermediary_name", "intermediary_type", "parent_organization", "territory",
            "commission_structure", "commission_rate", "agreement_id", "agreement_start_date", "tier_assigned",
            "active_flag", "client_count",
        ),
        ("distributor", "broker", "reseller", "intermediary", "channel partner"),
        {"intermediary_type": "distributor"},
    ),
    Table(
        "dim_vendor_platform", ("vendor_id",), ("vendor_id", "vendor_name", "vendor_type"),
        (
            "vendor_id", "vendor_name", "vendor_type", "parent_organization", "contract_terms_summary",
            "cost_model", "active_client_count", "active_flag", "geography", "market_share_estimate",
        ),
        ("vendor", "supplier", "platform"),
        {"vendor_type": "other"},
    ),
    Table(
        "fact_revenue", ("transaction_id",),
        ("transaction_id", "transaction_date", "customer_id", "product_sku", "grain_type"),
        (
            "transaction_id", "transaction_date", "customer_id", "product_sku", "quantity", "list_price",
            "invoice_price", "revenue", "grain_type", "data_source_id", "cogs", "volume_discount",
            "prompt_pay_discount", "rebate_amount", "freight_absorption", "special_pricing_agreement",
            "sales_channel", "sales_rep_id", "intermediary_id", "vendor_id", "geography", "currency",
            "promotional_flag", "contract_id", "co_op_marketing", "credit_memo_amount", "exchange_rate",
            "promotion_id",
        ),
        ("transaction", "revenue", "invoice", "sales fact", "order line"),
        {"grain_type": "invoice_line"},
    ),
    Table(
        "fact_deal_opportunity", ("deal_id",), ("deal_id", "customer_id", "deal_outcome"),
        (
            "deal_id", "customer_id", "deal_outcome", "deal_close_date", "product_sku", "list_price_quoted",
            "final_price", "discount_pct", "deal_value", "sales_rep_id", "customer_segment", "loss_reason",
            "competitor_cited", "sales_cycle_days", "approval_level", "initial_discount_requested", "override_flag",
            "number_of_approvals", "data_source_id",
        ),
        ("deal", "opportunity", "crm", "pipeline", "won lost"),
        {"deal_outcome": "Won"},
    ),
    Table(
        "fact_recurring_revenue", ("id",), ("customer_id", "arrangement_type"),
        (
            "customer_id", "arrangement_type", "plan_tier", "plan_price", "billing_cycle", "plan_start_date",
            "usage_volume", "tier_limit", "churn_flag", "churn_date", "churn_reason", "price_change_at_renewal",
            "price_increase_pct", "nps_score", "usage_trend_3m", "intermediary_id", "data_source_id",
        ),
        ("subscription", "arr", "mrr", "recurring", "saas"),
        {"arrangement_type": "annual_agreement"},
    ),
    Table(
        "fact_cost_to_serve", ("id",), ("customer_id", "period"),
        (
            "customer_id", "period", "service_cost", "logistics_cost", "returns_credits_cost", "intermediary_cost",
            "customization_cost", "payment_terms_cost", "sales_coverage_cost", "order_frequency", "avg_order_size",
            "data_source_id",
        ),
        ("cost to serve", "cts", "service cost", "logistics cost"),
    ),
    Table(
        "fact_list_price_history", ("id",), ("product_sku", "effective_date", "list_price"),
        (
            "product_sku", "effective_date", "list_price", "price_tier", "previous_list_price", "change_pct",
            "change_reason", "geography", "data_source_id",
        ),
        ("list price", "price history", "price change"),
        {"price_tier": "Default"},
    ),
    Table(
        "fact_competitive_intel", ("id",), ("competitor_name",),
        (
            "competitor_name", "competitor_product", "own_product_sku", "competitor_price", "price_type",
            "observation_date", "source", "confidence_level", "market_segment", "feature_comparison_score",
            "geography", "data_source_id",
        ),
        ("competitive", "competitor", "market price", "benchmarking"),
    ),
    Table(
        "fact_rebate_incentive", ("rebate_id",), ("rebate_id", "customer_id", "period", "rebate_type"),
        (
            "rebate_id", "contract_id", "customer_id", "product_sku", "period", "rebate_type", "accrued_amount",
            "claimed_amount", "paid_amount", "status", "qualifying_volume", "tier_threshold", "intermediary_id",
            "data_source_id",
        ),
        ("rebate", "incentive", "back-end discount"),
    ),
]

TABLES: dict[str, Table] = {t.name: t for t in _TABLES}

# Names tried when no keyword fits; all words of one group must occur.
FALLBACK_RULES = [
    ("dim_customer", (("customer", "dim"), ("customer", "master"), ("customer", "list"))),
    ("dim_product", (("product",), ("sku",), ("catalog",))),
    ("dim_sales_rep", (("rep",), ("salesperson",))),
    ("dim_contract", (("contract",),)),
    ("fact_revenue", (("revenue",), ("transaction",), ("invoice",), ("sales",))),
    ("fact_deal_opportunity", (("deal",), ("opportunity",), ("pipeline",))),
    ("fact_rebate_incentive", (("rebate",),)),
    ("fact_recurring_revenue", (("subscription",), ("arr",), ("mrr",))),
]

# Other spellings of a header, tried in this order after the exact name.
ALIASES = {
    "customer_id": ("cust_id", "account_id", "buyer_id", "client_customer_id", "id"),
    "customer_name": ("account_name", "company_name", "buyer_name", "customer", "client_name"),
    "product_sku": ("sku", "product_code", "item_code", "item_id", "product_id"),
    "product_name": ("item_name", "product_description", "product_desc", "name"),
    "transaction_id": ("txn_id", "invoice_id", "order_id", "line_id", "id"),
    "transaction_date": ("invoice_date", "order_date", "txn_date", "date", "sale_date"),
    "revenue": ("amount", "net_revenue", "sales_amount", "invoice_amount", "net_amount", "total_amount"),
    "list_price": ("msrp", "standard_price", "base_price", "price"),
    "invoice_price": ("net_price", "final_price", "billed_price", "selling_price"),
    "discount_pct": ("discount", "discount_percent", "disc_pct", "rebate_pct"),
    "deal_id": ("opportunity_id", "opp_id", "crm_id"),
    "deal_outcome": ("outcome", "status", "win_loss", "result"),
    "sales_rep_id": ("rep_id", "owner_id", "agent_id"),
    "sales_rep_name": ("rep_name", "owner_name", "rep", "salesperson"),
    "contract_id": ("agreement_id", "contract_number"),
}

# Spellings and routes of the benefits-management domain.
BENEFITS_ALIASES = {
    "lives_covered": ("lives", "members"),
    "pepm_rate": ("pepm",),
    "pmpm_rate": ("pmpm",),
    "revenue": ("net_revenue", "nr"),
    "gross_margin": ("gp", "gross_profit"),
    "broker_name": ("broker", "ga", "consultant"),
    "effective_date": ("effective_date", "jan_1"),
}
BENEFITS_ROUTES = {
    "pepm": "contract",
    "pmpm": "contract",
    "book of business": "book_of_business_fact",
    "bob": "book_of_business_fact",
    "validated sales": "transaction_fact",
    "terminations": "terminations_fact",
    "p&l": "monthly_financials",
    "gross profit": "transaction_fact",
    "marketing agreement": "contract",
    "target bookings": "deal_opportunity",
    "competitive landscape": "competitor_fact",
    "conjoint": "voc_fact",
    "survey": "voc_fact",
}

# Flags, and numeric columns whose name carries no date.
BOOLEANS = frozenset((
    "promotional_flag", "override_flag", "churn_flag", "auto_renewal_flag", "price_change_at_renewal",
    "strategic_flag", "active_flag",
))
NUMERICS = frozenset((
    "credit_score", "member_count", "current_list_price", "standard_cost", "tenure_months", "quota",
    "contracted_price", "escalation_pct", "promotional_price", "regular_price", "promotional_cost",
    "commission_rate", "client_count", "active_client_count", "market_share_estimate", "quantity", "list_price",
    "invoice_price", "revenue", "cogs", "volume_discount", "prompt_pay_discount", "rebate_amount",
    "freight_absorption", "co_op_marketing", "credit_memo_amount", "exchange_rate", "list_price_quoted",
    "final_price", "discount_pct", "deal_value", "sales_cycle_days", "initial_discount_requested",
    "number_of_approvals", "plan_price", "usage_volume", "price_increase_pct", "nps_score", "usage_trend_3m",
    "service_cost", "logistics_cost", "returns_credits_cost", "intermediary_cost", "customization_cost",
    "payment_terms_cost", "sales_coverage_cost", "order_frequency", "avg_order_size", "previous_list_price",
    "change_pct", "competitor_price", "feature_comparison_score", "accrued_amount", "claimed_amount", "paid_amount",
    "qualifying_volume", "tier_threshold",
))


def column_type(name: str) -> T.DataType:
    """Dates by name, flags and numbers by list, text otherwise."""
    if name in BOOLEANS:
        return T.BooleanType()
    if name in NUMERICS:
        return T.DecimalType(18, 4)
    if name.endswith("_date"):
        return T.DateType()
    return T.StringType()


# The bronze tables an extraction may fill.
BRONZE = {
    "transaction_fact": (
        "transaction_id", "transaction_date", "customer_name", "customer_id", "product_name", "product_sku",
        "service_type", "revenue", "list_price", "invoice_price", "pocket_price", "discount_pct", "discount_amount",
        "quantity", "unit_price", "cost_of_goods", "gross_margin", "currency", "sales_rep_name", "sales_rep_id",
        "channel", "region", "deal_size_bucket", "order_id", "invoice_id",
    ),
    "customer_dim": (
        "customer_id", "customer_name", "segment", "industry", "vertical", "region", "tier", "company_type",
        "company_size", "geography", "state", "city", "lead_source", "annual_revenue", "lifetime_value",
        "churn_risk", "churn_status", "contract_status",
    ),
    "product_dim": (
        "product_sku", "product_name", "category", "subcategory", "pricing_method", "list_price", "cost",
        "margin_pct", "feature_summary", "launch_date", "status",
    ),
    "sales_rep_dim": (
        "sales_rep_id", "sales_rep_name", "email", "region", "territory", "team", "manager", "hire_date", "quota",
        "commission_rate",
    ),
    "deal_opportunity": (
        "deal_id", "customer_name", "opportunity_name", "deal_type", "deal_stage", "deal_amount", "probability",
        "expected_revenue", "account_owner", "close_date", "source",
    ),
    "contract": (
        "contract_id", "customer_name", "start_date", "end_date", "term_months", "contract_value", "annual_value",
        "renewal_status", "payment_terms",
    ),
    "list_price_history": (
        "product_sku", "product_name", "effective_date", "list_price", "previous_price", "change_pct",
    ),
    "monthly_financials": ("period", "line_item", "category", "amount", "budget_amount", "variance"),
}

# Tables and columns the benefits-management variant adds.
BRONZE_BENEFITS = {
    "transaction_fact": (
        "pepm_rate", "pmpm_rate", "lives_covered", "contract_value", "annual_value", "broker_name", "deal_type",
    ),
    "book_of_business_fact": (
        "client_id", "client_name", "effective_date", "expiration_date", "product_name", "pepm_rate", "pmpm_rate",
        "lives_covered", "annual_value", "contract_type", "broker_name", "segment", "region", "renewal_status",
        "contract_status", "year_label",
    ),
    "customer_dim": ("broker_name", "broker_firm"),
    "product_dim": ("list_pepm", "list_pmpm"),
    "deal_opportunity": ("lives_covered", "pepm_rate", "broker_name", "year_label"),
    "contract": ("pepm_rate", "pmpm_rate", "lives_covered", "pricing_model", "broker_name"),
    "terminations_fact": (
        "termination_id", "client_name", "client_id", "termination_date", "effective_date", "product_name",
        "lives_covered", "annual_value", "pepm_rate", "reason", "sales_rep_name", "broker_name", "region",
        "year_label",
    ),
    "competitor_fact": (
        "competitor_name", "client_name", "proposal_date", "product_name", "pepm_rate", "pmpm_rate", "discount_pct",
        "contract_value", "deal_outcome", "competitive_notes", "data_source",
    ),
    "monthly_financials": ("client_count", "lives_covered", "avg_pepm"),
    "voc_fact": (
        "survey_id", "respondent_type", "survey_date", "client_name", "broker_name", "overall_satisfaction",
        "nps_score", "product_rating", "service_rating", "question_text", "response_text", "year_label",
    ),
}


def bronze_columns(table: str, benefits: bool = False) -> tuple[str, ...]:
    base = BRONZE.get(table, ())
    extra = BRONZE_BENEFITS.get(table, ()) if benefits else ()
    return tuple(dict.fromkeys((*base, *extra)))


# Name fragments of numeric silver columns, and bronze columns typed as numbers.
NUMERIC_FRAGMENTS = (
    "revenue", "price", "cost", "amount", "value", "discount", "quantity", "margin", "pct", "rate", "quota",
    "budget", "commission", "variance", "probability", "score", "index",
)
BRONZE_NUMBERS = (
    "revenue", "deal_amount", "contract_value", "annual_value", "amount", "list_price", "invoice_price",
    "pocket_price", "unit_price", "cost_of_goods", "gross_margin", "discount_pct", "discount_amount", "quantity",
    "margin_pct", "quota", "commission_rate",
)
BENEFITS_NUMBERS = ("cost", "pepm_rate", "pmpm_rate", "lives_covered", "net_revenue")

# Columns each of the twenty analyses reads: (table, column) pairs.
ANALYSES = {
    "Pocket Price Waterfall": ("fact_revenue.list_price", "fact_revenue.quantity", "fact_revenue.cogs"),
    "Margin Bridge": ("fact_revenue.revenue", "fact_revenue.cogs", "fact_revenue.transaction_date"),
    "Price-Volume-Mix": ("fact_revenue.revenue", "fact_revenue.quantity", "fact_revenue.transaction_date"),
    "Customer Profitability": ("fact_revenue.revenue", "fact_revenue.cogs", "dim_customer.customer_name"),
    "Discount Effectiveness": ("fact_deal_opportunity.discount_pct", "fact_deal_opportunity.deal_value"),
    "Price Elasticity": ("fact_revenue.quantity", "fact_revenue.invoice_price"),
    "Contract Leakage": ("dim_contract.contracted_price", "fact_revenue.invoice_price"),
    "Deal Scorecard": ("fact_deal_opportunity.deal_outcome", "fact_deal_opportunity.sales_rep_id"),
    "Competitive Position": ("fact_competitive_intel.competitor_price",),
    "Price Corridor": ("fact_revenue.invoice_price", "fact_revenue.product_sku"),
    "SKU Pareto": ("fact_revenue.revenue", "fact_revenue.product_sku"),
    "New Product Pricing": ("dim_product.current_list_price", "fact_competitive_intel.competitor_price"),
    "Churn Risk": ("fact_revenue.revenue", "fact_revenue.transaction_date", "fact_revenue.customer_id"),
    "Geographic Pricing": ("fact_revenue.geography", "fact_revenue.revenue", "fact_revenue.quantity"),
    "Channel Conflict": ("fact_revenue.sales_channel", "fact_revenue.invoice_price"),
    "Promotion ROI": ("dim_promotion.promotion_start_date", "dim_promotion.promotional_cost"),
    "Cost-to-Serve": ("fact_cost_to_serve.service_cost",),
    "Rebate Optimization": ("fact_rebate_incentive.accrued_amount", "fact_rebate_incentive.paid_amount"),
    "Annual Escalation": ("fact_list_price_history.list_price", "fact_list_price_history.effective_date"),
    "Win/Loss": ("fact_deal_opportunity.deal_outcome", "fact_deal_opportunity.loss_reason"),
}
