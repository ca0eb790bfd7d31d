from decimal import Decimal

import pytest
from helpers import rows, write_xlsx
from pyspark.sql import functions as F

from pricewright.operators import headers, reshape
from pricewright.plans import bronze, gold, load, silver
from pricewright.sources import delimited, files, tables, workbook
from pricewright.sources.tables import TableStore, merge_into

DECISIONS = reshape.DECISION_SCHEMA


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("client data")
    (root / "deep + er").mkdir()
    (root / "long_tx.csv").write_text(
        'Account Name,Item Code,Invoice Date,Net Price,Amount,Amount\n'
        '"Acme, Inc",A1,45292,9.5,100,\n'
        'Acme Inc,A1,2024-02-01,9.5,50,60\n'
        'Zen,B2,3/1/2024,n/a,-20,\n'
        'Total,,,,190,\n'
        ',B2,2024-03-02,1,5,\n'
    )
    (root / "deep + er" / "wide_dates.csv").write_text(
        "Customer,Product,2024-01-01,2024-02-01,2024-03-01,2031-01-01,Notes\nAcme Inc,A1,0.005,n/a,-12.345,99,hi\n,,1,2,3,4,\nZen,,10,,30,,\n"
    )
    (root / "wide_months.tsv").write_text("Customer\tJan\tfeb\tMARCH\nZen\t1\t2\t3\n")
    (root / "~lock.csv").write_text("x,y\n1,2\n")
    (root / "notes.txt").write_text("nothing")
    grid = [["Rebate sheet"], None, ["Customer", "Product", "When", "Value"], ["Acme Inc", "A1", ("date", 45292), 10], ["Zen", "B2", ("date", 45293.5), 2.5], [None, "B2", None, 7]]
    names = ["Summary", "Cover"] + [f"Dist {i}" for i in range(10)]
    write_xlsx(root / "entities.xlsx", {n: grid for n in names})
    return str(root)


def decide(spark, *entries):
    return spark.createDataFrame(list(entries), DECISIONS)


LONG = {"Account Name": "customer_name", "Item Code": "product_name", "Invoice Date": "transaction_date", "Net Price": "invoice_price",
        "Amount": "revenue", "Amount_1": "revenue"}
WIDE = {"Customer": "customer_name", "Product": "product_name", "Notes": None}
BOOK = {"Customer": "customer_name", "Product": "product_name", "When": "transaction_date", "Value": "revenue"}


def all_decisions(spark):
    return decide(
        spark,
        ("LONG_TX.csv".lower(), "whatever", "transaction_fact", LONG, "long", ["exclude total rows", "drop blank names"], ["Account Name"]),
        ("deep + er/wide_dates.csv", "Sheet1", "transaction_fact, contract", WIDE, None, [], []),
        ("months", "Sheet1", "transaction_fact", {"Customer": "customer_name"}, "wide_months", None, None),
        ("entities.xlsx", headers.ALL_ENTITY_SHEETS, "transaction_fact", BOOK, "long", ["blank ids"], ["Customer"]),
        ("absent.xlsx", "S", "transaction_fact", BOOK, "long", [], []),
        ("entities.xlsx", "dist 99", "transaction_fact", BOOK, "long", [], []),
    )


def test_discovery_and_priority(spark, folder):
    found = files.discover(spark, folder)
    assert [r[0] for r in rows(found.select("file"))] == ["deep + er/wide_dates.csv", "entities.xlsx", "long_tx.csv", "wide_months.tsv"]
    pick = lambda wanted, by="name": [r[0] for r in rows(files.priority(found, wanted, by).select("file"))]
    assert pick(["long_tx.csv", "WIDE"]) == ["deep + er/wide_dates.csv", "long_tx.csv", "wide_months.tsv"]
    assert pick(["elsewhere/long_tx.csv"], "path") == ["long_tx.csv"]
    assert pick(["deep + er"], "folder") == ["deep + er/wide_dates.csv"]
    assert pick([]) == [r[0] for r in rows(found.select("file"))]


def test_delimited_cells(spark, folder):
    got = delimited.read_cells(spark, folder, "csv").filter("file = 'long_tx.csv'").orderBy("block", "seq").collect()
    assert [len(r.cells) for r in got] == [6, 5, 6, 5, 5, 5]
    assert got[1].cells[0] == "Acme, Inc" and got[3].cells[3] is None and got[5].cells[0] is None
    assert got[1].is_text == [True, True, False, False, False]


def test_rows_keep_their_order_over_file_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n,v\n" + "".join(f"{i},{i % 7}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cells = delimited.read_cells(spark, str(tmp_path), "csv")
        assert cells.rdd.getNumPartitions() > 4
        ordered = [r.cells[0] for r in cells.orderBy("block", "seq").collect()]
        assert ordered == ["n"] + [str(i) for i in range(20000)]
        plan = decide(spark, ("big.csv", "Sheet1", "transaction_fact", {"n": "order_id", "v": "revenue"}, "long", [], []))
        records, _ = bronze.extract(cells, plan)
        got = bronze.bronze_table(records, "transaction_fact", "P", "c").select("order_id", "transaction_id").collect()
        assert {int(r[0]) + 1: r[1] for r in got} == {i: f"P-TXN-{i:06d}" for i in range(1, 20001)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_workbook_cells(spark, folder):
    cells = workbook.read_cells(spark, folder)
    got = cells.filter("sheet = 'Dist 3'").orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 2, 3, 4, 5] and got[0].sheet_index == 5
    assert got[2].cells == ["Acme Inc", "A1", "2024-01-01 00:00:00", "10"] and got[2].is_text == [True, True, False, False]
    assert got[3].cells[2] == "2024-01-02 12:00:00" and got[4].cells[0] is None
    assert workbook.unreadable(files.discover(spark, folder), cells).count() == 0


def test_headers(spark):
    text = lambda r: [isinstance(c, str) for c in r]
    grid = [["Report title"], [None, "ab"], ["Name", "Amount", "Amount"], ["long text", "more text", "and more"], ["x", 1, 2]]
    cells = spark.createDataFrame([("b.xlsx", "S", 0, i, [None if c is None else str(c) for c in r], text(r)) for i, r in enumerate(grid)], headers.CELLS_SCHEMA)
    h = headers.sheet_summary(cells).first()
    assert h.seq == 2 and h.header == ["Name", "Amount", "Amount_1"]  # tie with row 3 goes to the earlier row
    names = spark.createDataFrame([(["A", None, "A", " A ", ""],)], "c array<string>").select(headers.header_names(F.col("c"))).first()[0]
    assert names == ["A", "Unnamed: 1", "A_1", "A_2", "Unnamed: 4"]
    csv = cells.withColumn("file", F.lit("b.csv"))
    assert headers.sheet_summary(csv).first().seq == 0
    assert headers.sheet_summary(csv, by_score=True).first().seq == 2


def test_date_headers(spark):
    df = spark.createDataFrame([(["Customer", "2024-01-01", "Jan 2025", "2031-01-01", "2017", "Feb"],), (["c", "jan", "May", "MARCH"],)], "h array<string>")
    got = df.select(headers.date_positions(F.col("h")).alias("d"), headers.date_positions(F.col("h"), 2015, 2030).alias("v"), headers.month_positions(F.col("h")).alias("m")).collect()
    assert [(e.pos, str(e.day)) for e in got[0].d] == [(2, "2024-01-01"), (3, "2025-01-01"), (4, "2031-01-01"), (5, "2017-01-01")]
    assert [(e.pos, str(e.day)) for e in got[0].v] == [(2, "2024-01-01"), (3, "2025-01-01"), (5, "2017-01-01")]
    assert got[1].d == [] and [(e.pos, str(e.day)) for e in got[1].m] == [(2, "2024-01-15"), (3, "2024-05-15"), (4, "2024-03-15")]


def test_sheet_sampling(spark):
    df = spark.createDataFrame([("big", f"s{i}", i) for i in range(40)] + [("small", f"s{i}", i) for i in range(5)], "file string, sheet string, sheet_index int")
    got = headers.sample_sheets(df)
    picked = sorted(r.sheet_index for r in got.filter("file = 'big'").collect())
    assert picked == [0, 1, 2, 3, 4, 10, 16, 22, 28, 34, 38, 39] and got.filter("file = 'small'").count() == 5
    assert headers.sample_sheets(df, 10, stride=False).filter("file = 'big'").count() == 10


def test_folder_to_dashboard(spark, folder, tmp_path):
    cells = bronze.read_folder(spark, folder)
    records, misses = bronze.extract(cells, all_decisions(spark))
    assert [r[:2] for r in rows(misses.select("file", "sheet"))] == [("absent.xlsx", "S"), ("entities.xlsx", "dist 99")]
    per_sheet = {(r.file, r.sheet): r.n for r in records.groupBy("file", "sheet").agg(F.count("*").alias("n")).collect()}
    assert per_sheet == {
        ("long_tx.csv", "Sheet1"): 3, ("deep + er/wide_dates.csv", "Sheet1"): 4, ("wide_months.tsv", "Sheet1"): 3,
        **{("entities.xlsx", f"Dist {i}"): 2 for i in range(10)},
    }
    built = bronze.build(records, ["transaction_fact"], "ACE", "Acme Client", positions=True)
    facts = built["transaction_fact"]
    got = rows(facts.filter("transaction_id <= 'ACE-TXN-000003'").select("transaction_id", "customer_name", "customer_id", "revenue", F.col("transaction_date").cast("date").cast("string")))
    assert got == [
        ("ACE-TXN-000001", "Acme Inc", "ACE-CUST-0001", Decimal("-12.3500"), "2024-03-01"),
        ("ACE-TXN-000002", "Acme Inc", "ACE-CUST-0001", Decimal("99.0000"), "2031-01-01"),
        ("ACE-TXN-000003", "Zen", "ACE-CUST-0003", Decimal("10.0000"), "2024-01-01"),
    ]
    assert facts.count() == 30 and facts.select("transaction_id").distinct().count() == 30
    last = facts.filter("customer_name = 'Acme Inc' and transaction_date = '2024-02-01'").first()
    assert last.revenue == Decimal("60.0000") and last.client_name == "Acme Client"

    cleaned, log, report = silver.to_silver(built)
    assert report.first().row_delta == 0
    assert cleaned["transaction_fact"].filter("revenue_type = 'credit/adjustment'").count() == 2

    store = TableStore(spark, str(tmp_path / "store"))
    silver_tables = {"sales transactions": cleaned["transaction_fact"].drop("client_name")}
    dry = load.load(store, silver_tables, "acme", "Acme Client", dry_run=True).first()
    assert (dry.target_table, dry.rows, dry.rejected) == ("fact_revenue", 25, 5) and not store.exists("fact_revenue")
    load.load(store, silver_tables, "acme", "Acme Client")
    load.load(store, silver_tables, "acme", "Acme Client")  # the same load again changes nothing
    stored = store.read("fact_revenue")
    assert stored.count() == 25 and store.read("clients").first().total_records == 25
    for name, n in (("meta_data_source", 1), ("meta_run", 1), ("rejected", 5)):  # records of one load, however often it ran
        assert spark.read.parquet(f"{store.root}/{name}").count() == n
    more = {n: df.limit(df.count() - 1) for n, df in silver_tables.items()}
    load.load(store, more, "acme", "Acme Client")
    assert spark.read.parquet(f"{store.root}/meta_run").count() == 2
    load.load(store, silver_tables, "acme", "Acme Client")
    pareto = gold.read_view("sku_pareto", store.read, "acme").orderBy("cum_pct").collect()
    assert pareto[-1].cum_pct == pytest.approx(100) and len(pareto) == 2


def test_silver_keeps_the_last_load(spark):
    deals = spark.createDataFrame(
        [("Acme", "big", "90", "f", 1), ("Acme", "big", "10", "f", 2), ("Zen", None, "7", "f", 3), ("Zen", None, "7", "f", 4), ("Zen", None, "1", "f", 5)],
        "customer_name string, opportunity_name string, deal_amount string, file string, seq int",
    ).withColumn("_position", F.struct("file", "seq")).drop("file", "seq")
    out, log, report = silver.to_silver({"deal_opportunity": deals})
    assert rows(out["deal_opportunity"]) == sorted([("Acme", "big", 10.0), ("Zen", None, 1.0)], key=repr)
    assert {r.action: r.affected for r in log.collect()} == {"drop_duplicates": 1}
    assert report.select("bronze_rows", "silver_rows", "bronze_cols", "silver_cols").first() == (5, 2, 3, 3)


def test_benefits_tables(spark):
    fields = {"client_name": "client_name", "termination_date": "termination_date", "lives": "lives_covered"}
    grid = [("t.csv", "Sheet1", 0, 0, 0, ["client_name", "termination_date", "lives"]), ("t.csv", "Sheet1", 0, 0, 1, ["B Co", "45292", "12"]), ("t.csv", "Sheet1", 0, 0, 2, ["A Co", "x", "n"])]
    cells = spark.createDataFrame([(*g, [True] * 3) for g in grid], "file string, sheet string, sheet_index int, block long, seq long, cells array<string>, is_text array<boolean>")
    both = [("t.csv", "Sheet1", t, fields, "long", [], []) for t in ("terminations_fact",)]
    options = bronze.BronzeOptions.for_benefits()
    records, _ = bronze.extract(cells, decide(spark, *both), options)
    out = bronze.build(records, ["terminations_fact"], "PBM", "ignored", options)["terminations_fact"]
    got = rows(out.select("termination_id", "client_name", F.col("termination_date").cast("date").cast("string"), "lives_covered"))
    assert got == [("PBM-TERM-00001", "B Co", "2024-01-01", Decimal("12.0000")), ("PBM-TERM-00002", "A Co", None, None)]
    book = records.withColumn("target_table", F.lit("book_of_business_fact"))
    named = bronze.build(book, ["book_of_business_fact"], "PBM", "ignored", options)["book_of_business_fact"]
    assert rows(named.select("client_name", "client_id")) == [("A Co", "PBM-CLI-0001"), ("B Co", "PBM-CLI-0002")]
    unlinked = load.termination_links({"terminations_fact": out, "book_of_business_fact": named.filter("client_name = 'A Co'")}, "PBM")
    assert rows(unlinked) == [("PBM", "B Co", 1)] and load.termination_links({"terminations_fact": out}, "PBM") is None


def test_store_keeps_other_clients(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read("t")
    frame = lambda *r: spark.createDataFrame(list(r), "client_id string, k string, v int")
    store.upsert("t", frame(("a", "1", 1), ("a", "2", 2), ("b/c d", "1", 3)), ["client_id", "k"])
    store.upsert("t", frame(("a", "2", 20), ("a", "3", 30), ("a", "3", 31)), ["client_id", "k"], F.col("v"))
    assert rows(store.read("t")) == [("a", "1", 1), ("a", "2", 20), ("a", "3", 31), ("b/c d", "1", 3)]
    assert rows(store.read("t", "b/c d")) == [("b/c d", "1", 3)]
    store.replace("t", frame(("a", "9", 9)))
    assert rows(store.read("t")) == [("a", "9", 9), ("b/c d", "1", 3)]
    wider = spark.createDataFrame([("a", "9", 9, "x")], "client_id string, k string, v int, w string")
    store.replace("t", wider)
    assert rows(store.read("t")) == [("a", "9", 9, "x"), ("b/c d", "1", 3, None)]
    store.replace("t", frame(("z", "1", 1)).limit(0), ["a"])
    assert rows(store.read("t").select("client_id", "k", "v")) == [("b/c d", "1", 3)]
    plan = store.read("t", "b/c d")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_merge_is_idempotent(spark):
    target = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "client_id string, k int, v string")
    source = spark.createDataFrame([("c", 2, "B"), ("c", 3, "C")], "client_id string, k int, v string")
    once = merge_into(target, source, ["client_id", "k"])
    assert rows(once) == rows(merge_into(once, source, ["client_id", "k"])) == [("c", 1, "a"), ("c", 2, "B"), ("c", 3, "C")]


def test_load_order():
    assert tables.in_load_order(["meta_x", "fact_revenue", "dim_product", "dim_customer"]) == ["dim_customer", "dim_product", "fact_revenue", "meta_x"]


def test_layer_reading(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "contract_silver"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    spark.range(2).write.parquet(str(tmp_path / "cleaning_log"))
    got = tables.read_layer(spark, str(tmp_path), ["contract_silver", "empty", "cleaning_log"])
    assert list(got) == ["contract"]
