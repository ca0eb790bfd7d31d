"""Reconciliation between layers, foreign keys, quality score, analysis coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ANALYSES
from ..functions.numeric import num, ratio

# Weights of the four parts of the score, and the lower limits of the grades.
WEIGHTS = {"completeness": 0.4, "validity": 0.2, "uniqueness": 0.2, "integrity": 0.2}
GRADES = ((90.0, "A"), (75.0, "B"), (60.0, "C"))


def _layer(tables: Mapping[str, DataFrame], layer: str) -> DataFrame:
    """Rows, columns, revenue and distinct customers of each table of a layer."""
    parts = []
    for name, df in tables.items():
        has_name, has_revenue = "customer_name" in df.columns, "revenue" in df.columns
        amount = F.sum(F.col("revenue").cast("string").try_cast("decimal(28,4)")) if has_revenue else F.lit(None).cast("decimal(38,4)")
        # Count by name first: one very frequent customer is then a single row.
        group = [F.col("customer_name").alias("_name")] if has_name else [F.lit(None).cast("string").alias("_name")]
        per_name = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), amount.alias("r"))
        parts.append(
            per_name.agg(
                F.lit(name).alias("table"),
                F.coalesce(F.sum("n"), F.lit(0)).alias(f"{layer}_rows"),
                F.lit(len(df.columns)).alias(f"{layer}_cols"),
                F.round(F.coalesce(F.sum("r"), F.lit(0)), 2).cast("double").alias(f"{layer}_revenue") if has_revenue else F.lit(None).cast("double").alias(f"{layer}_revenue"),
                F.count("_name").alias(f"{layer}_customers") if has_name else F.lit(None).cast("long").alias(f"{layer}_customers"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def reconcile(bronze: Mapping[str, DataFrame], silver: Mapping[str, DataFrame]) -> DataFrame:
    """One row per silver table: rows, columns, revenue and customers before and after."""
    left = _layer(bronze, "bronze") if bronze else None
    right = _layer(silver, "silver")
    if left is None:
        left = right.limit(0).select("table", *[F.col(c).alias(c.replace("silver", "bronze")) for c in right.columns[1:]])
    both = right.join(left, "table", "left")
    has_revenue = F.col("silver_revenue").isNotNull()
    before = F.coalesce("bronze_revenue", F.lit(0.0))
    zero = F.lit(0)
    return both.select(
        "table",
        F.coalesce("bronze_rows", zero).alias("bronze_rows"),
        "silver_rows",
        (F.col("silver_rows") - F.coalesce("bronze_rows", zero)).alias("row_delta"),
        F.coalesce("bronze_cols", zero).alias("bronze_cols"),
        "silver_cols",
        F.when(has_revenue, before).alias("bronze_revenue"),
        "silver_revenue",
        F.round((F.col("silver_revenue").cast("decimal(28,2)") - before.cast("decimal(28,2)")), 2).cast("double").alias("revenue_delta"),
        "bronze_customers",
        "silver_customers",
    )


def orphans(fact: DataFrame, dim: DataFrame, keys: Sequence[str], fact_name: str = "fact", dim_name: str = "dim") -> DataFrame:
    """Fact keys without a dimension row and how many fact rows carry them. Facts shrink to keys before the join."""
    present = F.lit(True)
    for k in keys:
        if k != "client_id":
            present = present & F.col(k).isNotNull()
    counted = fact.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    missing = counted.join(dim.select(*keys).distinct(), list(keys), "left_anti")
    return missing.select(F.lit(fact_name).alias("fact"), F.lit(dim_name).alias("dim"), *keys, "rows")


def quality_score(
    df: DataFrame,
    table: str,
    required: Sequence[str],
    keys: Sequence[str],
    valid,
    parents: Mapping[str, DataFrame] | None = None,
    client: str = "client_id",
) -> DataFrame:
    """Score 0-100 and grade per client.

    completeness: filled share of the required cells; validity: share of rows meeting ``valid``; uniqueness: distinct
    keys over rows; integrity: share of rows whose parent keys exist. Rows are counted by key and parent before
    anything is joined, so frequent keys stay one row.
    """
    parents = dict(parents or {})
    filled = sum((F.col(c).isNotNull().cast("int") for c in required[1:]), F.col(required[0]).isNotNull().cast("int"))
    base = df.groupBy(client).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(filled).alias("filled"), F.count_if(valid).alias("valid")
    )
    distinct = df.select(client, *keys).distinct().groupBy(client).agg(F.count(F.lit(1)).alias("distinct_keys"))
    out = base.join(distinct, client)
    checks = []
    for i, (column, parent) in enumerate(parents.items()):
        counted = df.groupBy(client, column).agg(F.count(F.lit(1)).alias("n"))
        linked = counted.join(parent.select(client, column).distinct(), [client, column], "left_semi")
        out = out.join(linked.groupBy(client).agg(F.sum("n").alias(f"_linked{i}")), client, "left")
        checks.append(F.coalesce(F.col(f"_linked{i}"), F.lit(0)))
    if checks:
        linked_share = ratio(sum(checks[1:], checks[0]), F.col("rows") * len(checks))
    else:
        linked_share = F.lit(1.0)
    parts = {
        "completeness": ratio("filled", F.col("rows") * len(required)),
        "validity": ratio("valid", "rows"),
        "uniqueness": ratio("distinct_keys", "rows"),
        "integrity": linked_share,
    }
    scored = out.select(client, F.lit(table).alias("table"), "rows", *[c.alias(n) for n, c in parts.items()])
    score = sum((F.col(n) * w for n, w in list(WEIGHTS.items())[1:]), F.col("completeness") * WEIGHTS["completeness"]) * 100
    return scored.withColumn("score", score).withColumn("grade", _grade(F.col("score")))


def _grade(score: Column) -> Column:
    grade = F.when(score >= GRADES[0][0], GRADES[0][1])
    for limit, letter in GRADES[1:]:
        grade = grade.when(score >= limit, letter)
    return grade.otherwise("D")


def overall_grade(scores: DataFrame, client: str = "client_id") -> DataFrame:
    """(client, score, grade) over a client's tables, each weighted by its rows."""
    whole = scores.groupBy(client).agg(ratio(F.sum(F.col("score") * F.col("rows")), F.sum("rows")).alias("score"))
    return whole.withColumn("grade", _grade(F.col("score")))


def unlinked_terminations(terminations: DataFrame, clients: DataFrame, name: str = "client_name") -> DataFrame:
    """(client_name, rows) of terminated clients that the book of business does not know, compared trimmed and in lower case."""
    def key(c):
        return F.lower(F.trim(c))

    counted = terminations.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
    known = clients.select(key(F.col(name)).alias("_known")).distinct()
    return counted.join(known, key(F.col(name)) == F.col("_known"), "left_anti")


def available_columns(tables: Mapping[str, DataFrame], client: str = "client_id") -> DataFrame:
    """(client, 'table.column') of the columns holding at least one value."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != client]
        counts = df.groupBy(client).agg(*[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(columns)])
        entries = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("column"), F.col(f"_c{i}").alias("n")) for i, c in enumerate(columns)])
        parts.append(counts.select(client, F.explode(entries).alias("e")).filter(F.col("e.n") > 0).select(client, "e.column"))
    return reduce(DataFrame.unionByName, parts)


def analysis_coverage(available: DataFrame, client: str = "client_id") -> DataFrame:
    """Which of the twenty analyses have all their columns, and what the others lack. One row per column at most."""
    have = available.groupBy(client).agg(F.collect_set("column").alias("have"))
    needs = F.array(*[
        F.struct(F.lit(a).alias("analysis"), F.array(*[F.lit(c) for c in cols]).alias("needs")) for a, cols in ANALYSES.items()
    ])
    lacking = F.array_sort(F.array_except("n.needs", "have"))
    return have.withColumn("n", F.explode(needs)).select(
        client, "n.analysis", (F.size(lacking) == 0).alias("is_covered"), F.array_join(lacking, ", ").alias("missing")
    )


def benefits_checks(df: DataFrame) -> DataFrame:
    """Checks of the benefits-management tables: rates and lives numeric, names present."""
    checks = []
    for c in df.columns:
        if c in ("pepm_rate", "pmpm_rate", "lives_covered"):
            text = F.trim(F.col(c).cast("string"))
            checks.append((c, "numeric", F.count_if(text.isNotNull() & text.try_cast("double").isNull())))
        elif c in ("client_name", "customer_name"):
            checks.append((c, "present", F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "")))
    if not checks:
        raise ValueError("none of the checked columns is present")
    counts = df.agg(*[n.alias(f"_k{i}") for i, (_, _, n) in enumerate(checks)])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("check"), F.col(f"_k{i}").alias("violations")) for i, (c, kind, _) in enumerate(checks)
    ])
    return counts.select(F.explode(entries).alias("e")).select("e.*")
