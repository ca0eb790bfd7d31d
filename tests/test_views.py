"""Views on tiny frames, their invariants, and the shape of their plans."""

from datetime import date
from decimal import Decimal

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.driver.bindings import Bindings
from pricewright.operators import intervals, ordering
from pricewright.plans import filters, gold, market_views, revenue_views, rollups

FOLDER = "/root/testdata/sf0.001"
REVENUE = "client_id string, customer_id string, product_sku string, transaction_date date, quantity decimal(18,4), revenue decimal(18,4)"


@pytest.fixture(scope="module")
def tables(spark):
    return Bindings(spark, FOLDER)


def facts(spark, *lines):
    return spark.createDataFrame([(c, u, s, date.fromisoformat(d), Decimal(q), Decimal(r)) for c, u, s, d, q, r in lines], REVENUE)


def test_waterfall_indices_add_up(tables):
    for r in gold.view("waterfall", tables.table).collect():
        steps = sum(r[c] for c in revenue_views.WATERFALL_STEPS)
        assert r.invoice_price_index == pytest.approx(100 - steps)
        assert r.pocket_margin_index == pytest.approx(r.invoice_price_index - r.cogs_index)


def test_waterfall_bars(tables):
    bars = rollups.waterfall_bars(gold.view("waterfall", tables.table)).filter("client_id = 'ASIA'").orderBy("step").collect()
    assert [b.name for b in bars if b.base == 0] == ["List Price", "Invoice Price", "Pocket Margin"]
    assert bars[1].base == pytest.approx(100 + bars[1].value) and bars[8].base == pytest.approx(bars[7].value + bars[8].value)


def test_pareto_ends_at_hundred_and_does_not_depend_on_slices(spark, tables, uncoalesced):
    once = rows(gold.view("sku_pareto", tables.table))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(gold.view("sku_pareto", tables.table)) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for client in {r[0] for r in once}:
        assert max(r[3] for r in once if r[0] == client) == pytest.approx(100)


def test_price_volume_mix_with_new_and_lost_products(spark):
    f = facts(spark, ("c", "u", "a", "2020-01-01", "10", "100"), ("c", "u", "lost", "2020-01-01", "5", "100"),
              ("c", "u", "a", "2021-01-01", "12", "144"), ("c", "u", "new", "2021-02-01", "1", "30"), ("c", "u", "a", "2023-01-01", "1", "1"))
    got = rows(revenue_views.price_volume_mix(f))
    assert len(got) == 1 and got[0][1] == "2021"  # 2023 has no year before it
    _, _, price, volume, mix, total = got[0]
    assert price == pytest.approx((12 - 10) * 12)
    assert volume == pytest.approx((13 - 15) * 200 / 15)
    assert total == pytest.approx(174 - 200) == price + volume + mix


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(2019, 2022), st.integers(1, 9), st.integers(1, 500)), min_size=1, max_size=25))
def test_price_volume_mix_adds_up(spark, lines):
    f = facts(spark, *[("c", "u", s, f"{y}-05-05", str(q), str(r)) for s, y, q, r in lines])
    for r in revenue_views.price_volume_mix(f).collect():
        assert r.price + r.volume_effect + r.mix == pytest.approx(r.total, abs=1e-4)


def test_cohorts(spark):
    f = facts(spark, ("c", "u", "a", "2020-01-15", "1", "10.005"), ("c", "u", "a", "2020-03-01", "1", "5"), ("c", "v", "a", "2020-03-09", "1", "7"))
    assert rows(revenue_views.cohort_revenue(f)) == [("c", "2020-01", "2020-01", 1, 10.01), ("c", "2020-01", "2020-03", 1, 5.0), ("c", "2020-03", "2020-03", 1, 7.0)]
    since = spark.createDataFrame([("c", "v", date(2019, 7, 2))], "client_id string, customer_id string, customer_since_date date")
    assert ("c", "2019-07", "2020-03", 1, 7.0) in rows(revenue_views.cohort_revenue(f, since))


def test_promotion_windows(spark):
    promos = spark.createDataFrame(
        [("p1", "a", "2020-02-01", "2020-02-10", "10"), ("p2", "a", "2020-02-10", "2020-02-01", "10"), ("p3", None, None, None, "0")],
        "promotion_id string, product_sku string, s string, e string, promotional_cost string",
    ).select(
        F.lit("c").alias("client_id"), "promotion_id", "product_sku", F.lit("t").alias("promotion_type"), F.col("s").cast("date").alias("promotion_start_date"),
        F.col("e").cast("date").alias("promotion_end_date"), F.lit(8).alias("promotional_price"), F.lit(10).alias("regular_price"), "promotional_cost",
        F.lit("x").alias("target_segment"), F.lit("y").alias("promotion_channel"),
    )
    f = facts(spark, ("c", "u", "a", "2020-01-21", "1", "999"), ("c", "u", "a", "2020-01-22", "1", "1"), ("c", "u", "a", "2020-01-31", "1", "2"), ("c", "u", "a", "2020-02-01", "1", "30"),
              ("c", "u", "a", "2020-02-10", "1", "5"), ("c", "u", "a", "2020-02-11", "1", "999"), ("d", "u", "a", "2020-02-05", "1", "999"))
    got = {r.promotion_id: r for r in market_views.promotion_roi(promos, f).collect()}
    p1 = got["p1"]
    assert (p1.promo_txn_count, p1.promo_revenue, p1.baseline_revenue, p1.revenue_lift, round(p1.roi_pct, 9), p1.performance_band) == (2, 35.0, 3.0, 32.0, 220.0, "High Performer")
    assert p1.discount_depth_pct == pytest.approx(20) and got["p2"].promo_revenue == 0 and got["p3"].roi_pct is None


def test_interval_join_equals_brute_force(spark):
    days = spark.range(0, 400).select(F.lit("k").alias("k"), F.date_add(F.lit("2019-11-20").cast("date"), F.col("id").cast("int")).alias("day"))
    windows = spark.range(0, 60).select(F.lit("k").alias("k"), "id", F.date_add(F.lit("2019-12-01").cast("date"), (F.col("id") * 5).cast("int")).alias("a")).withColumn("b", F.date_add("a", (F.col("id") % 50).cast("int")))
    fast = rows(intervals.within(days, windows, ["k"], "day", "a", "b").select("id", "day"))
    slow = rows(days.join(windows, "k").filter("day between a and b").select("id", "day"))
    assert fast == slow and len(fast) > 1000


def test_filters_commute_with_views(tables):
    sub = filters.filter_revenue(tables.fact_revenue, tables.dim_customer, segments=["BUILDING"], client_id="ASIA")
    direct = rows(gold.view("customer_profitability", tables.table, overrides={"fact_revenue": sub}))
    later = rows(gold.view("customer_profitability", tables.table, "ASIA").filter("segment = 'BUILDING'"))
    assert direct == later and direct
    with pytest.raises(ValueError):
        filters.filter_revenue(tables.fact_revenue, tables.dim_customer, period="someday")


def test_table_builder_refuses_unknown_columns(tables):
    assert filters.build_table(tables.dim_customer, ["customer_name", "client_id"]).columns == ["customer_name", "client_id"]
    for bad in ([], ["nope"], ["client_id", "client_id"]):
        with pytest.raises(ValueError):
            filters.build_table(tables.dim_customer, bad)


def test_single_row(tables):
    assert gold.single_row(gold.view("waterfall", tables.table, "ASIA")).count() == 1
    with pytest.raises(ValueError):
        gold.single_row(tables.dim_customer)


def test_hot_client_is_spread_over_slices(spark, uncoalesced):
    """One group holding nearly all rows is numbered by several tasks and still gets 1..n."""
    df = spark.range(20000).select(F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("g"), F.hash("id").alias("v"), "id")
    out = ordering.running(df.repartition(8), ["g"], [F.col("v"), F.col("id")], {"c": F.lit(1).cast("long")}, "n")
    checked = out.groupBy("g").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.count_if(F.col("n") != F.col("c")))
    assert rows(checked) == [("hot", 1, 19800, 19800, 0), ("small", 1, 200, 200, 0)]
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(gold.VIEWS))
def test_no_cross_joins_and_no_windows_over_a_client(tables, name):
    plan = gold.view(name, tables.table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    if name not in ("price_volume_mix", "opportunities", "cohort_revenue", "sku_pareto"):
        assert "Window [" not in plan


def test_scans_are_pruned(tables):
    plan = plan_of(gold.view("discount_governance", tables.table, "ASIA"))
    orders = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "o_orderkey" in line][0]
    assert "o_orderpriority" not in orders and "o_totalprice" in orders
    assert "EqualTo(r_name,ASIA)" in plan
