"""Nothing is cut, lost or overwritten by chance: ingest, loads, keys, percentiles, windows."""

import random
import re

from helpers import rows, write_xlsx
from pyspark.sql import functions as F

from pricewright.operators import headers, intervals, ordering, quality, reshape
from pricewright.plans import bronze, load, named_analyses, opportunities, revenue_views, silver
from pricewright.sources import delimited
from pricewright.sources.tables import TableStore

DECISIONS = reshape.DECISION_SCHEMA


def test_positions_hold_when_the_file_layout_changes(spark, tmp_path):
    sizes = [200, 500, 700, 800, 900, 1100]
    for i, n in enumerate(sizes):
        (tmp_path / f"f{i}.csv").write_text("id,v\n" + "".join(f"{i}-{j},{j + 1}\n" for j in range(n)))
    told = spark.createDataFrame([(f"f{i}.csv", "Sheet1", "transaction_fact", {"id": "order_id", "v": "revenue"}, "long", [], []) for i in range(6)], DECISIONS)
    key, results = "spark.sql.files.openCostInBytes", []
    old = spark.conf.get(key)
    try:
        for first, second in (("4194304", "0"), ("0", "8388608")):
            spark.conf.set(key, first)
            records, _ = bronze.extract(bronze.read_folder(spark, str(tmp_path)), told)
            spark.conf.set(key, second)
            out = bronze.build(records, ["transaction_fact"], "P", "c")["transaction_fact"]
            results.append({(r.order_id, r.transaction_id) for r in out.collect()})
    finally:
        spark.conf.set(key, old)
    assert len(results[0]) == sum(sizes) == 4200 and results[0] == results[1]


def test_wide_files_keep_all_cells(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(f"c{i}" for i in range(700)) + "\n" + ",".join(str(i) for i in range(700)) + '\n"a,b",x\n')
    cells = delimited.read_cells(spark, str(tmp_path), "csv").orderBy("seq").collect()
    assert [len(r.cells) for r in cells] == [700, 700, 2] and cells[1].cells[699] == "699" and cells[2].cells[0] == "a,b"
    header = headers.sheet_summary(spark.createDataFrame(cells)).first().header
    assert len(header) == 700 and header[699] == "c699"


def test_all_entity_sheets_are_read(spark, tmp_path):
    grid = [["Customer", "Value here"], ["Acme", 5]]
    write_xlsx(tmp_path / "b.xlsx", {f"Dist {i}": grid for i in range(20)})
    told = spark.createDataFrame([("b.xlsx", headers.ALL_ENTITY_SHEETS, "transaction_fact", {"Customer": "customer_name", "Value here": "revenue"}, "long", [], [])], DECISIONS)
    records, _ = bronze.extract(bronze.read_folder(spark, str(tmp_path)), told)
    assert records.select("sheet").distinct().count() == 20


def test_two_names_of_a_client_merge_too(spark):
    facts = spark.createDataFrame([("Acme Inc", "1"), ("ACME, Inc.", "2")], "customer_name string, amount string")
    out, _, _ = silver.to_silver({"transaction_fact": facts})
    assert {r.customer_name for r in out["transaction_fact"].collect()} == {"ACME, Inc."}


def test_running_and_keep_last_keep_null_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert rows(ordering.running(df, ["g"], [F.col("v")], {"c": F.col("v")}, "n", totals={"t": "c"})) == sorted([(None, 1, 1, 1, 3), (None, 2, 3, 2, 3), ("a", 3, 3, 1, 3)], key=repr)
    late = spark.createDataFrame([("k", None, "x"), ("k", None, "y"), ("j", 1, "p"), ("j", None, "q")], "k string, o int, v string")
    assert rows(ordering.keep_last(late, ["k"], F.col("o"))) == sorted([("k", None, "y"), ("j", 1, "p")], key=repr)


def test_percentiles_are_exact_beyond_ten_thousand_values(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 10**9) for _ in range(25_000)]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 5), ("h", None)], "g string, v long")
    got = {r.g: (r.low, r.high, r._rows) for r in ordering.exact_percentiles(df, ["g"], "v", {"low": 0.1, "high": 0.9}).collect()}
    ordered = sorted(values)
    assert got == {"g": (ordered[2499], ordered[22499], 25_000), None: (5, 5, 1), "h": (None, None, 1)}


def test_open_ended_windows_cost_nothing(spark):
    days = spark.createDataFrame([("k", "2024-01-05"), ("k", "2024-03-01")], "k string, d string").select("k", F.col("d").cast("date").alias("d"))
    windows = spark.createDataFrame([("k", 1, "0001-01-01", "9999-12-31"), ("k", 2, "2024-02-01", "9999-12-31"), ("k", 3, "2025-01-01", "9999-12-31")], "k string, id int, a string, b string")
    windows = windows.select("k", "id", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    met = intervals.within(days, windows, ["k"], "d", "a", "b")
    assert rows(met.select("id", F.col("d").cast("string"))) == [(1, "2024-01-05"), (1, "2024-03-01"), (2, "2024-03-01")]


def customers(spark, *found):
    return spark.createDataFrame(list(found), "customer_id string, customer_name string, industry string")


def test_the_last_source_wins_and_rejects_are_kept(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    old = customers(spark, ("1", "Acme", "Z-old"), (None, "Nobody", "x"))
    new = customers(spark, ("1", "Acme", "A-new"))
    out = load.load(store, {"customer_1_old": old, "customer_2_new": new}, "c", "C")
    assert store.read("dim_customer").first().industry == "A-new"
    assert {(r.source, r.rows, r.rejected) for r in out.collect()} == {("customer_1_old", 1, 1), ("customer_2_new", 1, 0)}
    kept = spark.read.parquet(f"{store.root}/rejected").first()
    assert (kept.source, kept.target_table) == ("customer_1_old", "dim_customer") and "Nobody" in kept.row
    status = {r.source_file_name: r.validation_status for r in spark.read.parquet(f"{store.root}/meta_data_source").collect()}
    assert status == {"customer_1_old": "partial", "customer_2_new": "passed"}
    assert spark.read.parquet(f"{store.root}/meta_run").count() == 2


def test_a_load_is_graded_and_its_keys_are_checked(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    facts = spark.createDataFrame([("1", "2024-01", "5"), ("9", "2024-01", "7")], "customer_id string, period string, service_cost string")
    tables = {"cost": "fact_cost_to_serve", "customer_dim": "dim_customer"}
    load.load(store, {"customer_dim": customers(spark, ("1", "Acme", "x")), "cost": facts}, "c", "C", tables=tables)
    orphan = spark.read.parquet(f"{store.root}/fk_report").first()
    assert (orphan.fact, orphan.dim, orphan.key, orphan.rows) == ("fact_cost_to_serve", "dim_customer", "9", 1)
    assert store.read("clients").first().data_quality_grade == "A"
    scores = {r.table: round(r.integrity, 2) for r in spark.read.parquet(f"{store.root}/quality_report").collect()}
    assert scores == {"dim_customer": 1.0, "fact_cost_to_serve": 0.5}


def test_unlinked_terminations(spark):
    gone = spark.createDataFrame([("Acme ",), ("Zen",), ("Zen",), (None,)], "client_name string")
    assert rows(quality.unlinked_terminations(gone, spark.createDataFrame([("ACME",)], "client_name string"))) == [("Zen", 2)]


def test_generated_keys_are_unique_over_sources(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    # Two sources with an equal row: each row keeps an id of its own.
    same = spark.createDataFrame([("1", "2024-01", "5")], "customer_id string, period string, service_cost string")
    load.load(store, {"cost to serve a": same, "cost to serve b": same}, "c", "C", tables={"cost to serve a": "fact_cost_to_serve", "cost to serve b": "fact_cost_to_serve"})
    stored = store.read("fact_cost_to_serve")
    assert stored.count() == 2 and stored.select("id").distinct().count() == 2


def test_the_store_lists_only_live_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    frame = lambda *r: spark.createDataFrame(list(r), "client_id string, v int")
    store.replace("t", frame(("a", 1), ("b", 1)))
    store.replace("t", frame(("a", 2)))
    store.replace("t", frame(("a", 3)))
    read = store.read("t")
    assert rows(read) == [("a", 3), ("b", 1)]
    listed = lambda df: {f.split("version=")[1][0] for f in df.inputFiles() if "version=" in f}
    assert listed(read) == {"1", "3"}
    assert rows(store.read("t", "a")) == [("a", 3)] and listed(store.read("t", "a")) == {"3"}
    assert store.drop_old_versions("t") == [2] and rows(store.read("t")) == [("a", 3), ("b", 1)]


def test_layers_are_written_and_read(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    record = load.write_layer(store, {"contract": spark.range(3).withColumn("client_name", F.lit("C"))}, "c", "silver")
    assert record.first().rows == 3
    assert load.read_client_layer(store, ["contract"], "c", "silver")["contract"].count() == 3


def test_one_scan_of_the_facts(spark, tmp_path):
    spark.createDataFrame(
        [("c", str(i % 3), str(i % 5), f"2024-0{i % 9 + 1}-01", "10", "5", "2", "1") for i in range(50)],
        "client_id string, customer_id string, product_sku string, d string, revenue string, cogs string, quantity string, list_price string",
    ).select("*", F.col("d").cast("date").alias("transaction_date")).write.parquet(str(tmp_path / "facts"))
    spark.createDataFrame([("c", "0", "n", "5")], "client_id string, customer_id string, customer_name string, nps_score string").write.parquet(str(tmp_path / "dim"))
    facts, dim = spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "dim"))
    out = revenue_views.churn_risk(facts, dim, dim)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet [^\n]*product_sku|FileScan parquet [^\n]*revenue", plan)) == 1
    assert plan.count("ReusedExchange") >= 1


def test_one_scan_for_all_opportunities(spark, tmp_path):
    day = F.expr("date_add(date'2024-01-01', cast(id % 300 as int))")
    facts = spark.range(500).select(
        F.lit("c").alias("client_id"), (F.col("id") % 7).cast("string").alias("customer_id"), (F.col("id") % 3).cast("string").alias("geography"), day.alias("transaction_date"),
        *[F.col("id").cast("string").alias(c) for c in ("revenue", "cogs", "quantity")])
    facts.write.parquet(str(tmp_path / "facts"))
    deals = spark.createDataFrame([("c", "Won", "40", "1000")], "client_id string, deal_outcome string, discount_pct string, deal_value string")
    rebates = spark.createDataFrame([("c", "50", "20")], "client_id string, accrued_amount string, paid_amount string")
    customers = spark.createDataFrame([("c", "1", "n")], "client_id string, customer_id string, customer_name string")
    recurring = spark.createDataFrame([("c", "1", "5")], "client_id string, customer_id string, nps_score string")
    out = opportunities.opportunities(spark.read.parquet(str(tmp_path / "facts")), deals, rebates, customers, recurring)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and "ReusedExchange" in plan


def test_all_opportunity_rules_can_fire(spark):
    revenue = spark.createDataFrame([
        ("c", "1", "north", "90", "100", "10", "2024-06-30"), ("c", "2", "south", "300", "50", "10", "2024-06-30"), ("c", "3", "west", "2000", "500", "20", "2024-01-01"),
    ], "client_id string, customer_id string, geography string, revenue string, cogs string, quantity string, d string").withColumn("transaction_date", F.col("d").cast("date"))
    deals = spark.createDataFrame([("c", "Won", "40", "1000")], "client_id string, deal_outcome string, discount_pct string, deal_value string")
    rebates = spark.createDataFrame([("c", "50", "20")], "client_id string, accrued_amount string, paid_amount string")
    customers = spark.createDataFrame([("c", "3", "gone")], "client_id string, customer_id string, customer_name string")
    recurring = spark.createDataFrame([("c", "3", "10")], "client_id string, customer_id string, nps_score string")
    got = {r.type: round(r.impact_mid, 4) for r in opportunities.opportunities(revenue, deals, rebates, customers, recurring).collect()}
    assert got == {"Discount": 250.0, "Margin": 10.0, "Rebate": 30.0, "Geography": 805.0, "Retention": 1000.0}


def test_price_corridor_counts_all_rows(spark):
    df = spark.createDataFrame([("c", "s", str(i)) for i in range(1, 11)] + [("c", "s", None)], "client_id string, product_sku string, invoice_price string")
    r = named_analyses.price_corridor(df).first()
    assert (r.p10, r.p50, r.p90, r.transactions) == (1.0, 5.0, 9.0, 11)
