from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from pricewright.functions import dates, numeric, text


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_serial_edges(spark):
    got = one(spark, ["24999", "25000", "25001", "45000.5", "54999", "55000"], dates.serial_to_timestamp)
    assert got[0] is None and got[1] is None and got[5] is None
    assert got[2] == datetime(1968, 6, 12)
    assert got[3] == datetime(2023, 3, 15, 12)
    assert got[4] == datetime(2050, 7, 30)


def test_dates_parse_in_listed_formats(spark):
    got = one(spark, ["2024-02-03", " 3/4/2024 ", "2024-02-03 10:11:12", "Mar 5, 2024", "1970-01-01", "soon", None, "45292"], dates.parse_date)
    assert got == [date(2024, 2, 3), date(2024, 3, 4), date(2024, 2, 3), date(2024, 3, 5), date(1970, 1, 1), None, None, date(2024, 1, 1)]


def test_periods(spark):
    assert one(spark, ["2024-Q3", "2024-07", "2024", "later"], dates.period_start) == [date(2024, 7, 1), date(2024, 7, 1), date(2024, 1, 1), None]


def test_booleans(spark):
    assert one(spark, ["TRUE", "1", "Yes", "false", "0", "NO", "maybe", None], text.parse_bool) == [True, True, True, False, False, False, None, None]


def test_text_repair(spark):
    assert one(spark, [" a ", "nan", "None", "NaT", "", "NAN", None], text.blank_to_null) == ["a", None, None, None, None, "NAN", None]
    assert one(spark, ["  ACME & Sons, Inc. ", "--x--", "é"], text.slug) == ["acme-sons-inc", "x", ""]
    assert one(spark, ["Ada Byron", "Cher", "Ann van Dam", None], text.short_name) == ["Ada B.", "Cher", "Ann D.", None]


def test_prefixes(spark):
    assert one(spark, ["Acme", "Acme Energy", "Big Red Dog Co", "", "R2 D2"], text.client_prefix) == ["ACM", "ACE", "BRD", "CLI", "RD"]
    assert one(spark, ["Acme_Bronze", "Acme_XYZ", "Acme Energy_LLM_v2", "My_LLM_Lab_Bronze_Output"], text.client_name_from_folder) == [
        "Acme", "Acme", "Acme Energy", "My_LLM_Lab"]


def test_customer_key(spark):
    long = "International Business Machines Corporation Europe "
    got = one(spark, ["Acme Inc.", "  ", None, "x" * 40, "x" * 60, long + "North", long + "South"], lambda c: text.customer_key(F.lit("client-9"), c))
    assert got[:4] == ["client-acme-inc", None, None, "client-" + "x" * 40]
    assert all(g.startswith("client-" + "x" * 40 + "-") for g in got[4:5]) and len(set(got[3:])) == 4


def test_money_labels(spark):
    assert one(spark, [2500000.0, 45000.0, 12.0], text.money_label, "double") == ["$2.5M", "$45K", "$12"]


def test_band_edges(spark):
    edges, labels = (500, 2000), ("a", "b", "c")
    left = one(spark, [499.99, 500.0, 1999.0, 2000.0, 2000.01], lambda c: numeric.band(c, edges, labels)["label"], "double")
    right = one(spark, [500.0, 500.01, 2000.0, 2001.0], lambda c: numeric.band(c, edges, labels, "right")["rank"], "double")
    assert left == ["a", "b", "b", "b", "c"] and right == [1, 2, 2, 3]


def test_ratio_and_rounding(spark):
    df = spark.createDataFrame([(Decimal("1.0000"), Decimal("0.0000"))], "a decimal(18,4), b decimal(18,4)")
    assert df.select(numeric.ratio("a", "b")).first()[0] is None
    assert one(spark, [2.675, -2.675, 900.015], lambda c: numeric.round_half_up(c, 2), "double") == [2.68, -2.68, 900.02]
    assert one(spark, [float("nan"), float("inf"), 1.5], numeric.clean_number, "double") == [None, None, 1.5]


def test_dates_are_read_once_per_value(spark):
    """Failed parses and casts cost most of the time of a cleaning: none is tried where the text shows that it must fail."""
    from pyspark.sql import functions as F

    from pricewright.operators import clean, date_order

    texts = ["35000.5", "0x1.8p15", "3/25/1998", "25/3/1998", "3.4.1998 9:15", "31/02/1998", "1998-03-12", "n.a.", " 12 "]
    df = spark.createDataFrame([(t,) for t in texts], "due_date string")
    got = df.select(date_order.vote(F.col("due_date")), dates.is_serial("due_date"), clean.as_number(F.col("due_date"))).collect()
    assert [r[0] for r in got] == [None, None, "month_only", "day_only", "either", None, None, None, None]
    assert [r[1] for r in got] == [True, True] + [False] * 7
    assert [r[2] for r in got] == [35000.5, 49152.0, None, None, None, None, None, None, 12.0]
    log = clean.clean(df, "t")[1]
    found = {r["action"]: r["affected"] for r in log.collect()}
    assert found == {"convert_serial_dates": 2, "guess_date_order": 1, "coerce_dates": 4, "drop_empty_rows": 4}
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("yyyyMMdd") for line in plan.splitlines()) == 1
