from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from pricewright.catalog import TABLES
from pricewright.functions import dates
from pricewright.operators import classify, clean, context, date_order, enrich, entities, keys, ordering, profile, quality, reshape


def test_running_matches_a_plain_window(spark, uncoalesced):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") * 7 % 11).cast("decimal(18,0)").alias("v"))
    got = {(r.g, r.k): (r.n, r.c) for r in ordering.running(df, ["g"], [F.col("v").desc(), F.col("k")], {"c": F.col("v")}, "n").collect()}
    for g in range(3):
        ordered = sorted(((-(k * 7 % 11), k) for k in range(1000) if k % 3 == g))
        acc = 0
        for n, (v, k) in enumerate(ordered, 1):
            acc -= v
            assert got[g, k] == (n, acc)


def test_keep_last_treats_nulls_as_one_group(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 1, "c"), ("x", 3, None)], "k string, n int, v string")
    assert rows(ordering.keep_last(df, ["k"], F.col("n"))) == sorted([(None, 2, "b"), ("x", 3, None)], key=repr)


def test_clean_order_and_log(spark):
    df = spark.createDataFrame(
        [("45000", " a ", "10", "Gold"), ("45000", " a ", "10", "Gold"), ("45000", "a", "10", "Gold"), ("1970-01-01", "nan", "x", "Tin"), (None, None, None, None)],
        "order_date string, note string, amount string, price_tier string",
    )
    out, log = clean.clean(df, "t")
    got = rows(out.select(F.col("order_date").cast("date").cast("string"), "note", "amount", "price_tier"))
    # The two spellings of note survive: duplicates are judged before trimming. price_tier stays text.
    assert got == [("1970-01-01", None, None, "Tin"), ("2023-03-15", "a", 10.0, "Gold"), ("2023-03-15", "a", 10.0, "Gold")]
    entries = {(r.column, r.action): r.affected for r in log.collect()}
    assert entries == {
        ("order_date", "convert_serial_dates"): 3, ("order_date", "flag_1970_dates"): 1, ("amount", "coerce_numeric"): 1,
        (None, "drop_empty_rows"): 1, (None, "drop_duplicates"): 1,
    }


def test_dates_are_read_in_the_order_of_their_column(spark):
    df = spark.createDataFrame([
        ("25/12/2023", "12/25/2023", "01/02/2023", "1.2.2023", "25/12/2023"),
        ("03/04/2023", "03/04/2023", "03/04/2023", "3.4.2023", "12/26/2023"),
        (" 3-4-2023 10:15 ", "2023-04-03", "soon", "30.2.2023", "12/27/2023"),
    ], "day_date string, month_date string, either_date string, dot_date string, mixed_date string")
    out, log = clean.clean(df, "t")
    got = {c: sorted(str(v) for v in out.toPandas()[c].dt.strftime("%Y-%m-%d %H:%M").fillna("-")) for c in out.columns}
    assert got == {
        "day_date": ["2023-04-03 00:00", "2023-04-03 10:15", "2023-12-25 00:00"], "month_date": ["2023-03-04 00:00", "2023-04-03 00:00", "2023-12-25 00:00"],
        "either_date": ["-", "2023-01-02 00:00", "2023-03-04 00:00"], "dot_date": ["-", "2023-02-01 00:00", "2023-04-03 00:00"],
        "mixed_date": ["-", "2023-12-26 00:00", "2023-12-27 00:00"],
    }
    entries = {(r.column, r.action): r.affected for r in log.collect()}
    assert entries == {
        ("either_date", "guess_date_order"): 2, ("either_date", "coerce_dates"): 1, ("dot_date", "guess_date_order"): 2, ("dot_date", "coerce_dates"): 1,
        ("mixed_date", "coerce_dates"): 1,
    }


def test_date_orders_per_file(spark):
    df = spark.createDataFrame([("eu.csv", "25/12/2023", None), ("eu.csv", "01/02/2023", "x"), ("us.csv", "01/02/2023", None), ("us.csv", "12/31/2023", None), (None, "01/02/2023", "9.9.2023")],
                               "file string, a string, b string")
    told = {(r.file, r.column): (r.order, r.ambiguous) for r in date_order.orders(df, ["a", "b"], ["file"]).collect()}
    assert told == {("eu.csv", "a"): ("day", False), ("us.csv", "a"): ("month", False), (None, "a"): ("month", True), (None, "b"): ("day", True)}
    read = date_order.with_orders(df, ["a", "b"], ["file"])
    got = rows(read.select("file", dates.parse_date("a", order=F.col("_orders")["a"]).cast("string")))
    assert got == sorted([("eu.csv", "2023-12-25"), ("eu.csv", "2023-02-01"), ("us.csv", "2023-01-02"), ("us.csv", "2023-12-31"), (None, "2023-01-02")], key=repr)
    assert date_order.orders(df.limit(0), ["a"], ["file"]).count() == 0


def test_catalog_type_beats_name_fragment(spark):
    df = spark.createDataFrame([("Default", "5")], "price_tier string, list_price string")
    out, _ = clean.clean(df, "t")
    assert rows(out) == [("Default", 5.0)]


def test_exclusions(spark):
    df = spark.createDataFrame([("Total Energy", "1", "a"), ("x", "2", "Grand TOTAL"), ("y", " ", "a"), ("z", None, "b"), ("w", "3", None)], "n string, i string, c string")
    assert [r[0] for r in rows(reshape.exclude_totals(df))] == ["w", "y", "z"]
    assert [r[0] for r in rows(reshape.exclude_totals(df, ["c"]))] == ["Total Energy", "w", "y", "z"]
    assert [r[0] for r in rows(reshape.exclude_blank_ids(df, ["nope", "i", "c"]))] == ["Total Energy", "w", "x"]
    assert [r[0] for r in rows(reshape.apply_exclusions(df, ["drop Total rows", "skip blank ids"], ["i"]))] == ["w"]


def test_long_project_last_value_wins(spark):
    df = spark.createDataFrame([("a", "1", "2"), ("b", "3", None), ("c", None, None)], "n string, x string, y string")
    got = rows(reshape.long_project(df, {"n": "customer_name", "x": "revenue", "y": "revenue", "q": "region"}))
    assert got == [("a", "2"), ("b", "3")]


def test_wide_unpivot(spark):
    df = spark.createDataFrame([("A", "0.005", "n/a", "-12.345"), (None, "5", "6", "7"), ("B", "1", None, "2.5")], "c string, d1 string, d2 string, d3 string")
    got = rows(reshape.wide_unpivot(df, {"c": "customer_name"}, {"d1": "2024-01-01", "d2": "2024-02-01", "d3": "2024-03-01"}))
    assert [(a, str(b), c) for a, b, c in got] == [("A", "2024-03-01", Decimal("-12.35")), ("B", "2024-01-01", Decimal("1.00")), ("B", "2024-03-01", Decimal("2.50"))]


def test_to_canonical(spark):
    df = spark.createDataFrame(
        [("Acme", "t1", "45292", "SKU", "10.5", "yes"), ("", "t2", "2024-01-02", "SKU", "x", "no")],
        "Customer string, txn_id string, invoice_date string, sku string, amount string, promotional_flag string",
    )
    mapping = {"Customer": "customer_name", "txn_id": "transaction_id", "invoice_date": "transaction_date", "sku": "product_sku", "amount": "revenue"}
    good, bad = reshape.to_canonical(df, "fact_revenue", mapping, "clientx")
    r = good.first()
    assert good.columns == ["client_id", *TABLES["fact_revenue"].columns]
    assert (r.customer_id, str(r.transaction_date), r.revenue, r.grain_type, r.promotional_flag) == ("client-acme", "2024-01-01", Decimal("10.5000"), "invoice_line", True)
    assert [x.transaction_id for x in bad.collect()] == ["t2"]
    with pytest.raises(ValueError):
        reshape.to_canonical(df.select(F.lit(1).alias("zzz")), "fact_revenue", {}, "c")


def test_keys_are_contiguous_and_grow_past_their_width(spark):
    df = spark.range(0, 12000, 1, 7).select(F.col("id").alias("seq"), F.lit("f").alias("file"))
    out = keys.sequence_keys(df, "deal_id", "DEAL", F.lit("ACE"), ["file", "seq"], chunk=keys.row_position("file"))
    got = {r.seq: r.deal_id for r in out.collect()}
    assert got[0] == "ACE-DEAL-0001" and got[9998] == "ACE-DEAL-9999" and got[11999] == "ACE-DEAL-12000"
    assert len(set(got.values())) == 12000


def test_row_position_slices(spark, monkeypatch):
    monkeypatch.setattr(keys, "SLICE_ROWS", 10)
    df = spark.range(0, 95).select(F.col("id").alias("seq"), F.when(F.col("id") < 50, "a").otherwise("b").alias("file"))
    out = keys.sequence_keys(df, "k", "TXN", F.lit("P"), ["file", "seq"], chunk=keys.row_position("file"))
    assert [r.k for r in out.orderBy("file", "seq").collect()] == [f"P-TXN-{i + 1:06d}" for i in range(95)]


def test_dictionary_keys(spark):
    df = spark.createDataFrame([(" b ",), ("a",), ("nan",), (None,), ("b",), ("C",)], "customer_name string")
    got = rows(keys.dictionary_keys(df, "customer_name", "customer_id", "CUST", F.lit("P")))
    assert got == sorted([(" b ", "P-CUST-0003"), ("a", "P-CUST-0002"), ("nan", ""), (None, ""), ("b", "P-CUST-0003"), ("C", "P-CUST-0001")], key=repr)


def test_content_keys_are_unique_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(keys, "COPIES_PER_TASK", 3)
    df = spark.createDataFrame([("a", 1)] * 8 + [("b", None)], "x string, y int")
    first = rows(keys.content_keys(df))
    assert len({r[0] for r in first}) == 9 and first == rows(keys.content_keys(df.repartition(5)))
    assert sum(r[1] == "a" for r in first) == 8


@pytest.mark.parametrize("name,whole,substring", [
    ("customer_list_2024", "dim_customer", "dim_customer"),
    ("carrier_rates", None, "fact_recurring_revenue"),
    ("Sales Fact 2023", "fact_revenue", "fact_revenue"),
    ("service cost by region", "fact_cost_to_serve", "fact_cost_to_serve"),
    ("invoices", "fact_revenue", "fact_revenue"),
    ("repairs", None, "dim_sales_rep"),
    ("misc", None, None),
])
def test_classification(spark, name, whole, substring):
    df = spark.createDataFrame([(name,)], "name string")
    assert classify.classify(df).first().target_table == whole
    assert classify.classify(df, whole_words=False).first().target_table == substring


def test_column_mapping_and_decisions(spark):
    cols = spark.createDataFrame(
        [("s", "fact_revenue", c) for c in ["Txn ID", "invoice-date", "SKU", "Amount", "Amt USD", "id", "Region"]], "source string, target_table string, column string"
    )
    mapped = classify.map_columns(cols)
    got = {r.column: r.canonical for r in mapped.collect()}
    assert got == {"Txn ID": "transaction_id", "invoice-date": "transaction_date", "SKU": "product_sku", "Amount": "revenue", "Amt USD": None, "id": "customer_id", "Region": None}
    told = spark.createDataFrame(
        [("s", "fact_revenue", "Amt USD", "invoice_price"), ("s", "fact_revenue", "SKU", "currency"), ("s", "fact_revenue", "Region", "nowhere")],
        "source string, target_table string, column string, canonical string",
    )
    final = {r.column: r.canonical for r in classify.apply_decisions(mapped, told).collect()}
    assert final["Amt USD"] == "invoice_price" and final["SKU"] == "product_sku" and final["Region"] is None


def test_routes(spark):
    df = spark.createDataFrame([("customer dim, contract",), ("contract + x",), (None,), ("a/b",)], "t string")
    assert [r[0] for r in df.select(classify.route(F.col("t"))).collect()] == ["customer_dim", "contract", "transaction_fact", "a"]


def test_name_groups(spark):
    names = ["Acme Energy Inc.", "ACME ENERGY", "Acme Enrgy", "Acme Energy, Incorporated", "Zenith Power LLC", "Zenith Pover", "Zenith Tower",
             "Store 001 North", "Store 002 North", "Apex", "Apec", "Northwind Traders"]
    got = {r.name: r.canonical for r in entities.name_groups(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert {got[n] for n in (names[0], names[1], names[3])} == {"Acme Energy, Incorporated"}
    # One letter apart is a candidate, not a merge.
    assert all(got[n] == n for n in ("Acme Enrgy", "Zenith Pover", "Zenith Power LLC", "Store 001 North", "Apex", "Apec", "Northwind Traders"))
    groups = entities.name_groups(spark.createDataFrame([(n,) for n in names], "name string"))
    near = {(r.canonical, r.near_canonical): round(r.score, 3) for r in entities.near_names(groups).collect()}
    assert near == {("Acme Enrgy", "Acme Energy, Incorporated"): 0.909, ("Zenith Pover", "Zenith Power LLC"): 0.917, ("Zenith Tower", "Zenith Power LLC"): 0.917, ("Apex", "Apec"): 0.75}
    merged = {r.name: r.canonical for r in entities.merge_map(groups, min_score=0.9).collect()}
    assert merged["Acme Enrgy"] == "Acme Energy, Incorporated" and merged["Zenith Pover"] == "Zenith Power LLC" and "Apex" not in merged


def test_names_do_not_chain(spark):
    names = ["Hansen Foods", "Jansen Foods", "Janson Foods", "Jonson Foods"]
    groups = entities.name_groups(spark.createDataFrame([(n,) for n in names], "name string"))
    assert entities.merge_map(groups).count() == 0
    moved = {r.name: r.canonical for r in entities.merge_map(groups, min_score=0.9).collect()}
    assert all(target not in moved for target in moved.values())  # nothing goes to a name that itself goes


def test_name_groups_do_not_depend_on_partitioning(spark):
    names = [f"company {w}{x} trading" for w in ("alpha", "alpho", "beta", "betas") for x in ("", "x")]
    a = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(entities.name_groups(a.repartition(1))) == rows(entities.name_groups(a.repartition(13)))


def brute_edges(names):
    def near(a, b):
        if a == b or "".join(c for c in a if c.isdigit()) != "".join(c for c in b if c.isdigit()):
            return False
        if len(a) == len(b):
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            return len(diff) == 1
        s, l = sorted((a, b), key=len)
        return len(l) == len(s) + 1 and any(l[:i] + l[i + 1:] == s for i in range(len(l)))
    root = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if near(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_merges_and_decisions(spark):
    groups = spark.createDataFrame([("a", "A Co"), ("b", "A Co"), ("A Co", "A Co")], "name string, canonical string")
    told = spark.createDataFrame([("a", "a")], "name string, canonical string")
    assert rows(entities.merge_map(groups, told)) == [("b", "A Co")]
    df = spark.createDataFrame([(" b ", 1), ("z", 2), (None, 3)], "customer_name string, n int")
    merges = entities.merge_map(groups)
    assert rows(enrich.apply_merges(df, merges)) == sorted([("A Co", 1), ("z", 2), (None, 3)], key=repr)


def test_enrich_fills_only_gaps(spark):
    df = spark.createDataFrame([("a", None), ("b", "Mining")], "customer_name string, industry string")
    look = spark.createDataFrame([("a", "Energy", "SMB"), ("b", "Retail", "")], "customer_name string, industry string, segment string")
    assert rows(enrich.enrich(df, look).select("customer_name", "industry", "segment", "tier")) == [("a", "Energy", "SMB", None), ("b", "Mining", None, None)]


def test_categories_first_match_wins(spark):
    df = spark.createDataFrame([("Net Sales",), ("Cost of Sales",), ("Gross margin",), ("Other",), ("Rent",), (None,)], "line_item string")
    got = {r[0]: r[1] for r in enrich.categorize(df).collect()}
    assert got == {"Net Sales": "revenue", "Cost of Sales": "revenue", "Gross margin": "margin", "Other": "uncategorized", "Rent": "expense", None: "uncategorized"}


def test_discount_and_negative_flag(spark):
    df = spark.createDataFrame([(100.0, 90.0, -1.0), (0.0, 1.0, 2.0), (None, 1.0, None)], "list_price double, invoice_price double, revenue double")
    got = rows(enrich.flag_negative(enrich.derive_discount(df)).select("discount_pct", "revenue_type"))
    assert got == sorted([(10.0, "credit/adjustment"), (None, "standard"), (None, "standard")], key=repr)


def test_reconcile_without_bronze(spark):
    silver = spark.createDataFrame([("a", 1.005), ("b", 2.0), ("a", None)], "customer_name string, revenue double")
    r = quality.reconcile({}, {"t": silver}).first()
    assert (r.bronze_rows, r.silver_rows, r.row_delta, r.silver_customers, r.revenue_delta) == (0, 3, 3, 2, 3.01)


def test_quality_grade(spark):
    df = spark.createDataFrame([("c", "k1", "p1", 1), ("c", "k1", "p9", None)], "client_id string, k string, p string, v int")
    parent = spark.createDataFrame([("c", "p1")], "client_id string, p string")
    r = quality.quality_score(df, "t", ["k", "v"], ["k"], F.col("v") > 0, {"p": parent}).first()
    assert (r.completeness, r.validity, r.uniqueness, r.integrity) == (0.75, 0.5, 0.5, 0.5)
    assert r.score == pytest.approx(60.0) and r.grade in ("C", "D")


def test_orphans(spark):
    fact = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "2"), ("c", None)], "client_id string, customer_id string")
    dim = spark.createDataFrame([("c", "1")], "client_id string, customer_id string")
    assert rows(quality.orphans(fact, dim, ["client_id", "customer_id"])) == [("fact", "dim", "c", "2", 2)]


def test_context(spark):
    facts = spark.createDataFrame(
        [("c", "industry", "Retail", "inferred-from-data", 1), ("c", "industry", "Mining", "extracted-from-deck.pptx", 2),
         ("c", "company_name", "Acme", "team-entered", 3), ("c", "company_name", "Acme Inc", "extracted-from-text", 1), ("c", "product_type", "[]", "team-entered", 1)],
        "client_id string, field string, value string, source string, seq int",
    )
    merged = context.merge_context(facts)
    assert rows(merged) == [("c", "company_name", "Acme", "team-entered", 1), ("c", "industry", "Mining", "extracted-from-deck.pptx", 1)]
    assert [r.value for r in context.alternatives(facts, merged).orderBy("field").collect()] == ["Acme Inc", "Retail"]
    r = context.missing_fields(merged, facts.select("client_id")).first()
    assert r.missing == 4 and r.fields.startswith("business_model") and not r.is_complete


def test_profiles(spark):
    df = spark.createDataFrame([(i, None if i < 2 else f"v{i}", "x") for i in range(6)], "n int, a string, b string")
    got = {r.column: (r.rows, r["columns"], list(r.samples)) for r in profile.profile(df, F.col("n")).collect()}
    assert got["a"] == (6, 3, ["v2", "v3", "v4"]) and got["n"][2] == ["0", "1", "2"]
    rates = {r.column: (round(r.fill_pct, 1), r.is_low) for r in profile.fill_rates(df).collect()}
    assert rates == {"n": (100.0, False), "a": (66.7, True), "b": (100.0, False)}
    cells = spark.createDataFrame([("x", "2"), ("x", "1"), ("x", "1"), ("y", None), (" x ", "3")], "column string, value string")
    inv = {r.column: (r.filled, list(r.samples)) for r in profile.inventory(cells, samples=2).collect()}
    assert inv == {"x": (4, ["1", "2"]), "y": (0, [])}


def test_benefits_checks(spark):
    df = spark.createDataFrame([("a", "1.5", "x"), (" ", "n", None)], "client_name string, pepm_rate string, lives_covered string")
    assert rows(quality.benefits_checks(df)) == [("client_name", "present", 1), ("lives_covered", "numeric", 1), ("pepm_rate", "numeric", 1)]


def test_payload_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert clean.without_nulls(df).first().payload == '{"a":1}'


def test_clashing_rows_have_one_winner(spark):
    names = spark.createDataFrame([("Acme",), ("Zen",)], "name string")
    told = spark.createDataFrame([("Acme", "Beta"), ("Acme", "Alpha")], "name string, canonical string")
    assert rows(entities.merge_map(entities.name_groups(names), told.repartition(3))) == [("Acme", "Alpha")]
    lookup = spark.createDataFrame([("A", "x", None), ("A", "z", "s"), ("A", "y", "s"), (None, "q", "q")], "customer_name string, industry string, segment string")
    out = enrich.enrich(spark.createDataFrame([("A",), (None,)], "customer_name string"), lookup.repartition(4))
    assert rows(out.select("customer_name", "industry", "segment")) == [("A", "y", "s"), (None, None, None)]
    headers = spark.createDataFrame([("s", "fact_revenue", "what")], "source string, target_table string, column string")
    clash = spark.createDataFrame([("s", "fact_revenue", "what", "revenue"), ("s", "fact_revenue", "what", "cogs")], "source string, target_table string, column string, canonical string")
    assert classify.apply_decisions(classify.map_columns(headers), clash).first()["canonical"] == "cogs"


def test_benefits_headers(spark):
    asked = [("transaction_fact", "NR", "revenue"), ("book_of_business_fact", "Lives", "lives_covered"), ("contract", "PEPM", "pepm_rate"), ("fact_revenue", "nr", "revenue"),
             ("terminations_fact", "GA", "broker_name"), ("book_of_business_fact", "jan_1", "effective_date"), ("fact_revenue", "Amount", "revenue"), ("contract", "nothing", None)]
    headers = spark.createDataFrame([("s", t, c) for t, c, _ in asked], "source string, target_table string, column string")
    got = {(r.target_table, r["column"]): r.canonical for r in classify.map_columns(headers, classify.benefits_rules()).collect()}
    assert got == {(t, c): m for t, c, m in asked}
    assert classify.map_columns(headers).where("canonical IS NOT NULL").count() == 1
