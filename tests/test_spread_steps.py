"""Steps that gave one task too much, or did their work once per pass."""

import re

from pricewright.driver.bindings import Bindings
from pricewright.operators import entities, similar_names
from pricewright.plans import filters

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_spread_before_they_multiply(spark):
    """Six rows a part come from many tasks, not from the one that reads the file."""
    intel = Bindings(spark, FOLDER).fact_competitive_intel
    sizes = [r["count"] for r in intel.groupBy(filters.F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 6 * Bindings(spark, FOLDER).raw("part").count()


def test_names_are_found_once(spark, tmp_path):
    """Near names, merges and token sets read staged names: the source is scanned by no later pass."""
    spark.createDataFrame([(n,) for n in ("Acme Corp", "ACME, Inc.", " ", "\t Acme Corp ", "Acmee Trading", "Acme Trading")], "name string").write.parquet(str(tmp_path / "src"))
    groups = entities.name_groups(spark.read.schema("name string").parquet(str(tmp_path / "src")))
    assert {(r.name, r.canonical) for r in groups.collect()} == {
        ("Acme Corp", "ACME, Inc."), ("ACME, Inc.", "ACME, Inc."), ("Acmee Trading", "Acmee Trading"), ("Acme Trading", "Acme Trading")}
    near = entities.near_names(groups)
    assert [(r.key, r.near_key) for r in near.collect()] == [("acme trading", "acmee trading")]
    for df in (near, entities.merge_map(groups, min_score=0.9), similar_names.similar_names(groups)):
        assert not re.search(r"FileScan[^\n]*/src\b", plan(df))


def test_periods_are_no_shuffle_by_client(spark):
    b = Bindings(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(filters.filter_revenue(b.fact_revenue, b.dim_customer, period="YTD"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[client_id#\d+\]", text)
