"""The driver's tables seen as canonical tables. Every formula is exact decimal arithmetic."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import quarter_text
from ..functions.numeric import money


# Columns of the driver's files; stating them spares one job per file and plan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _dec(value: str, precision: int = 4, scale: int = 2) -> Column:
    return F.lit(value).cast(f"decimal({precision},{scale})")


class Bindings:
    """Lazy canonical DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def home(self) -> DataFrame:
        """Customers with the client (region) they belong to."""
        nations = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.raw("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def home_orders(self) -> DataFrame:
        """Orders with their client and country, joined before line items so that those are shuffled by order only."""
        return self.raw("orders").join(
            self.home.select("c_custkey", "c_mktsegment", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey")
        )

    @cached_property
    def home_parts(self) -> DataFrame:
        """Parts with the client that owns them."""
        return self.raw("part").join(self.raw("region"), F.col("p_partkey") % 5 == F.col("r_regionkey"))

    @cached_property
    def fact_revenue(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        quantity = F.col("l_quantity").cast("decimal(10,0)")
        discount = F.col("l_discount").cast("decimal(4,2)")
        tax = F.col("l_tax").cast("decimal(4,2)")
        gross = price * quantity
        one = _dec("1", 1, 0)
        zero = money(F.lit(0))
        return (
            self.raw("lineitem")
            .join(self.home_orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
                F.col("r_name").alias("client_id"),
                F.col("l_shipdate").cast("date").alias("transaction_date"),
                F.col("o_custkey").alias("customer_id"),
                F.col("l_partkey").alias("product_sku"),
                F.col("l_suppkey").alias("sales_rep_id"),
                F.col("l_returnflag").alias("sales_channel"),
                F.col("n_name").alias("geography"),
                money(quantity).alias("quantity"),
                money(price).alias("list_price"),
                money(price * (one - discount)).alias("invoice_price"),
                money(gross * (one - discount)).alias("revenue"),
                money(gross * _dec("0.60")).alias("cogs"),
                money(gross * discount).alias("volume_discount"),
                money(gross * tax).alias("rebate_amount"),
                F.when(F.col("l_returnflag") == "N", money(gross * _dec("0.01"))).otherwise(zero).alias("prompt_pay_discount"),
                F.when(F.col("l_returnflag") == "R", money(gross * _dec("0.02"))).otherwise(zero).alias("freight_absorption"),
                F.when(F.col("l_linenumber") % 2 == 0, money(gross * _dec("0.01"))).otherwise(zero).alias("co_op_marketing"),
                F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), money(gross * _dec("0.05")))
                .otherwise(zero)
                .alias("credit_memo_amount"),
            )
        )

    @cached_property
    def fact_deal_opportunity(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        lost = F.col("o_orderstatus") == "P"
        share = (
            F.when(key % 5 == 0, _dec("0.001", 4, 3)).when(key % 5 == 1, _dec("0.010", 4, 3))
            .when(key % 5 == 2, _dec("0.050", 4, 3)).when(key % 5 == 3, _dec("0.200", 4, 3))
            .otherwise(_dec("1.000", 4, 3))
        )
        return (
            self.home_orders.select(
                key.cast("string").alias("deal_id"),
                F.col("r_name").alias("client_id"),
                customer.alias("customer_id"),
                F.when(F.col("o_orderstatus") == "F", "Won").when(lost, "Lost").otherwise("No Decision").alias("deal_outcome"),
                F.col("o_orderdate").cast("date").alias("deal_close_date"),
                money("o_totalprice").alias("deal_value"),
                money(F.col("o_totalprice").cast("decimal(12,2)") * share).alias("final_price"),
                money(key % 30).alias("discount_pct"),
                (key * 7 % 150).cast("int").alias("sales_cycle_days"),
                (customer % 20).alias("sales_rep_id"),
                F.col("c_mktsegment").alias("customer_segment"),
                F.when(lost, F.col("o_orderpriority")).alias("loss_reason"),
                F.when(lost, F.concat(F.lit("Competitor_"), (customer % 5).cast("string"))).alias("competitor_cited"),
                ((key % 30 > 20) & (key % 2 == 0)).alias("override_flag"),
            )
        )

    @cached_property
    def dim_customer(self) -> DataFrame:
        return self.home.select(
            F.col("r_name").alias("client_id"),
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("n_name").alias("geography_primary"),
        )

    @cached_property
    def dim_product(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        return self.home_parts.select(
            F.col("r_name").alias("client_id"),
            F.col("p_partkey").alias("product_sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"),
            F.col("p_brand").alias("product_family"),
            F.when(F.col("p_size") % 3 == 0, "Active").when(F.col("p_size") % 3 == 1, "Beta").otherwise("Pipeline").alias("product_status"),
            F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).alias("launch_date"),
            money(price).alias("current_list_price"),
            money(price * _dec("0.60")).alias("standard_cost"),
            F.lit("unit").alias("value_metric"),
            F.concat(F.lit("Rival "), F.col("p_brand")).alias("competitor_equivalent"),
        )

    @cached_property
    def dim_sales_rep(self) -> DataFrame:
        rep = F.col("c_custkey") % 20
        return (
            self.home.select(F.col("r_name").alias("client_id"), rep.alias("sales_rep_id"))
            .distinct()
            .select(
                "client_id",
                "sales_rep_id",
                F.concat(F.lit("Rep Number"), F.col("sales_rep_id").cast("string")).alias("sales_rep_name"),
                F.concat(F.lit("Territory "), (F.col("sales_rep_id") % 4).cast("string")).alias("territory"),
                F.when(F.col("sales_rep_id") % 2 == 0, "Enterprise").otherwise("SMB").alias("segment_coverage"),
                (F.col("sales_rep_id") + 6).cast("int").alias("tenure_months"),
                money((F.col("sales_rep_id") + 1) * 1000000).alias("quota"),
            )
        )

    @cached_property
    def fact_rebate_incentive(self) -> DataFrame:
        base = self.fact_revenue.groupBy("client_id", "customer_id", quarter_text("transaction_date").alias("period")).agg(
            F.sum("rebate_amount").alias("accrued")
        )
        kind = F.col("customer_id") % 4
        paid_share = _dec("0.80") + (F.col("customer_id") % 3).cast("decimal(1,0)") * _dec("0.01")
        return base.select(
            F.concat_ws("-", F.col("customer_id").cast("string"), "period").alias("rebate_id"),
            "client_id",
            "customer_id",
            "period",
            F.when(kind == 0, "volume").when(kind == 1, "growth").when(kind == 2, "loyalty").otherwise("promotional").alias("rebate_type"),
            money("accrued").alias("accrued_amount"),
            money(money("accrued") * _dec("0.95")).alias("claimed_amount"),
            money(money("accrued") * paid_share.cast("decimal(4,2)")).alias("paid_amount"),
        )

    @cached_property
    def fact_cost_to_serve(self) -> DataFrame:
        # Share of cost of goods each component takes.
        shares = {
            "service_cost": "0.05", "logistics_cost": "0.04", "returns_credits_cost": "0.02", "intermediary_cost": "0.03",
            "customization_cost": "0.01", "payment_terms_cost": "0.01", "sales_coverage_cost": "0.06",
        }
        base = self.fact_revenue.groupBy("client_id", "customer_id", quarter_text("transaction_date").alias("period")).agg(
            F.sum("cogs").alias("c"), F.sum("revenue").alias("r"), F.count(F.lit(1)).alias("n")
        )
        parts = [
            (F.when(F.col("customer_id") % 7 != 0, money(money("c") * _dec(v))) if k == "customization_cost" else money(money("c") * _dec(v))).alias(k)
            for k, v in shares.items()
        ]
        return base.select(
            "client_id", "customer_id", "period", *parts,
            F.col("n").alias("order_frequency"),
            (F.col("r").cast("double") / F.col("n").cast("double")).alias("avg_order_size"),
        )

    @cached_property
    def fact_list_price_history(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        steps = F.array(
            F.struct(F.lit("1999-01-01").cast("date").alias("day"), _dec("0.95").alias("f"), _dec("0.90").alias("g"), money(F.lit("5.5556")).alias("c"), F.lit("Inflation").alias("why")),
            F.struct(F.lit("2000-01-01").cast("date").alias("day"), _dec("1.00").alias("f"), _dec("0.95").alias("g"), money(F.lit("5.2632")).alias("c"), F.lit("Annual review").alias("why")),
        )
        return self.home_parts.withColumn("s", F.explode(steps)).select(
            F.col("r_name").alias("client_id"),
            F.col("p_partkey").alias("product_sku"),
            F.col("s.day").alias("effective_date"),
            money(price * F.col("s.f")).alias("list_price"),
            money(price * F.col("s.g")).alias("previous_list_price"),
            F.col("s.c").alias("change_pct"),
            F.col("s.why").alias("change_reason"),
        )

    @cached_property
    def dim_promotion(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        start = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int"))
        return self.home_parts.select(
            F.concat(F.lit("PROMO-"), F.col("p_partkey").cast("string")).alias("promotion_id"),
            F.col("r_name").alias("client_id"),
            F.col("p_partkey").alias("product_sku"),
            F.when(F.col("p_size") % 2 == 0, "volume_deal").otherwise("price_cut").alias("promotion_type"),
            start.alias("promotion_start_date"),
            F.date_add(start, 89).alias("promotion_end_date"),
            money(price * _dec("0.85")).alias("promotional_price"),
            money(price).alias("regular_price"),
            money(price * _dec("2.50")).alias("promotional_cost"),
            F.lit("All").alias("target_segment"),
            F.when(F.col("p_size") % 2 == 0, "online").otherwise("retail").alias("promotion_channel"),
        )

    @cached_property
    def fact_competitive_intel(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        k = F.col("k")
        factor = (
            F.when(k % 3 == 0, _dec("0.90")).when(k % 3 == 1, _dec("1.00")).otherwise(_dec("1.15"))
            - F.when(k >= 3, _dec("0.01")).otherwise(_dec("0.00"))
        ).cast("decimal(4,2)")
        # Parts are one small file; spread before they become six rows each, no task has to group them all.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = self.home_parts.select("r_name", "p_partkey", "p_retailprice", "p_size").repartition(tasks, "p_partkey")
        return spread.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
            F.col("r_name").alias("client_id"),
            F.concat(F.lit("Competitor_"), (k % 3).cast("string")).alias("competitor_name"),
            F.col("p_partkey").alias("own_product_sku"),
            money(price * factor).alias("competitor_price"),
            F.when(k >= 3, "street").otherwise("list").alias("price_type"),
            F.date_add(F.lit("2000-06-01").cast("date"), k).alias("observation_date"),
            F.when(k % 3 == 0, "High").otherwise("Medium").alias("confidence_level"),
            F.lit("Enterprise").alias("market_segment"),
            F.lit("National").alias("geography"),
            money(F.col("p_size").cast("decimal(4,0)") * _dec("0.02")).alias("feature_comparison_score"),
        )

    @cached_property
    def fact_recurring_revenue(self) -> DataFrame:
        usage = self.raw("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        return usage.join(self.home, F.col("user_id") == F.col("c_custkey")).select(
            F.col("r_name").alias("client_id"),
            F.col("user_id").alias("customer_id"),
            F.lit("annual_agreement").alias("arrangement_type"),
            money("n").alias("usage_volume"),
            money(F.col("n") % 11).alias("nps_score"),
        )

    @cached_property
    def dim_contract(self) -> DataFrame:
        return self.home.select(
            F.concat(F.lit("CTR-"), F.col("c_custkey").cast("string")).alias("contract_id"),
            F.col("r_name").alias("client_id"),
            F.col("c_custkey").alias("customer_id"),
            F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("contract_start_date"),
            F.date_add(F.lit("1999-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("contract_end_date"),
            money(F.col("c_custkey") % 100 + 900).alias("contracted_price"),
        )

    @cached_property
    def clients(self) -> DataFrame:
        key = F.col("k")
        return (
            self.home.groupBy(F.col("r_name").alias("client_id"), F.col("r_regionkey").alias("k"))
            .agg(F.count(F.lit(1)).alias("total_records"))
            .select(
                "client_id",
                F.concat(F.lit("Client "), "client_id").alias("client_name"),
                F.lit("Distribution").alias("industry"),
                F.lit("complete").alias("bronze_status"),
                F.when(key % 2 == 0, "complete").otherwise("pending").alias("silver_status"),
                F.when(key == 0, "complete").otherwise("pending").alias("gold_status"),
                "total_records",
                F.lit("2024-01-31").alias("last_run_at"),
                F.when(key < 3, "A").otherwise("B").alias("data_quality_grade"),
                (key % 2 == 0).alias("readiness_nda"),
                (key % 3 == 0).alias("readiness_data_dict"),
                (key > 1).alias("readiness_contact"),
                F.lit(True).alias("readiness_goals"),
            )
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
