"""Card totals computed on top of the views; every one is per client."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fixed_sum, num, percent, ratio
from ..operators.ordering import exact_percentiles

# Waterfall steps in drawing order, segments and outcomes shown, capture scenarios, readiness flags.
WATERFALL_ORDER = (
    ("List Price", "list_price_index", 1), ("Vol. Discount", "volume_discount_pct", -1), ("Prompt Pay", "prompt_pay_pct", -1),
    ("Rebates", "rebate_pct", -1), ("Freight", "freight_pct", -1), ("Co-op Mktg", "coop_pct", -1),
    ("Credit Memos", "credit_memo_pct", -1), ("Invoice Price", "invoice_price_index", 1), ("COGS", "cogs_index", -1),
    ("Pocket Margin", "pocket_margin_index", 1),
)
WATERFALL_ANCHORS = ("List Price", "Invoice Price", "Pocket Margin")
SEGMENTS = ("Enterprise", "Mid-Market", "SMB")
OUTCOMES = ("Won", "Lost", "No Decision")
CAPTURE = (("Conservative", 0.30), ("Moderate", 0.50), ("Ambitious", 0.70))
READINESS = (
    ("readiness_nda", "NDA"), ("readiness_data_dict", "Data Dict"), ("readiness_contact", "Contact"), ("readiness_goals", "Goals"),
)


def mean(value: Column | str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return ratio(fixed_sum(c), F.count(c))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark keeps only ``n`` per task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def waterfall_bars(view: DataFrame) -> DataFrame:
    """Bars of the waterfall: anchors stand on zero, the other steps hang from the running value."""
    steps = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), (F.col(c) * s).alias("value"),
                 F.lit(n in WATERFALL_ANCHORS).alias("anchor"))
        for i, (n, c, s) in enumerate(WATERFALL_ORDER)
    ])
    bars = view.select("client_id", F.explode(steps).alias("s")).select("client_id", "s.*")
    by_step = Window.partitionBy("client_id").orderBy("step")
    block = F.sum(F.col("anchor").cast("int")).over(by_step)
    level = F.sum("value").over(Window.partitionBy("client_id", "block").orderBy("step"))
    return bars.withColumn("block", block).select(
        "client_id", "step", "name", "value",
        F.when(F.col("anchor"), F.lit(0.0)).otherwise(level).alias("base"),
        F.abs("value").alias("height"),
    )


def revenue_at_risk(churn: DataFrame, high: float = 70, low: float = 30) -> DataFrame:
    zero = F.lit(0.0)
    score = F.col("risk_score")
    return churn.groupBy("client_id").agg(
        (fixed_sum(F.when(score > high, F.col("revenue")).otherwise(zero))).alias("revenue_at_risk"),
        (fixed_sum(F.when(score < low, F.col("revenue")).otherwise(zero))).alias("revenue_secured"),
        F.count_if(score > high).alias("high_risk"),
        F.count_if(score < low).alias("low_risk"),
        mean("risk_score").alias("avg_score"),
    )


def opportunity_totals(opps: DataFrame) -> DataFrame:
    """Total impact, the high-confidence part, and what each capture scenario would bring."""
    high = F.col("confidence") == "High"
    sums = opps.groupBy("client_id").agg(
        fixed_sum("impact_mid").alias("total_impact"),
        F.count_if(high).alias("high_confidence_count"),
        (fixed_sum(F.when(high, F.col("impact_mid")).otherwise(F.lit(0.0)))).alias("high_confidence_value"),
    )
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("capture")) for n, p in CAPTURE])
    return sums.withColumn("s", F.explode(scenarios)).select(
        "client_id", "total_impact", "high_confidence_count", "high_confidence_value",
        "s.scenario", (F.col("total_impact") * F.col("s.capture")).alias("captured"),
    )


def tier(clients: DataFrame) -> DataFrame:
    return clients.select(
        "client_id",
        F.when(F.col("gold_status") == "complete", "Gold").when(F.col("silver_status") == "complete", "Silver").otherwise("Bronze").alias("tier"),
        "total_records",
    )


def profitable_share(profit: DataFrame) -> DataFrame:
    """Share of customers with a margin of at least zero, and the extremes."""
    good = F.count_if(F.col("margin") >= 0)
    n = F.count(F.lit(1))
    return profit.groupBy("client_id").agg(
        percent(good, n).alias("profitable_pct"),
        percent(n - good, n).alias("unprofitable_pct"),
        F.max("margin").alias("max_margin"),
        F.min("margin").alias("min_margin"),
    )


def margin_deciles(profit: DataFrame) -> DataFrame:
    """Top and bottom decile margin."""
    return exact_percentiles(profit, ["client_id"], "margin", {"bottom_decile_margin": 0.1, "top_decile_margin": 0.9}).drop("_rows")


def team_summary(scorecard: DataFrame) -> DataFrame:
    """Unweighted means over reps, total won value, the best seller and the extreme win rates."""
    by_value = F.struct(F.col("revenue"), F.col("rep"))
    return scorecard.groupBy("client_id").agg(
        mean("win_rate").alias("avg_win_rate"),
        mean("avg_discount").alias("avg_discount"),
        fixed_sum("revenue").alias("total_revenue"),
        F.max(by_value)["rep"].alias("top_rep"),
        F.max("win_rate").alias("best_win_rate"),
        F.min("win_rate").alias("worst_win_rate"),
    )


def pareto_split(pareto: DataFrame, head: float = 80.0) -> DataFrame:
    inside = F.count_if(F.col("cum_pct") <= head)
    first = F.struct(-F.col("revenue"), F.col("sku"))
    return pareto.groupBy("client_id").agg(
        inside.alias("head_skus"), (F.count(F.lit(1)) - inside).alias("tail_skus"), F.min(first)["sku"].alias("top_sku")
    )


def geo_extremes(geo: DataFrame) -> DataFrame:
    order = F.struct(F.col("avg_price"), F.col("region"))
    return geo.groupBy("client_id").agg(
        F.max(order)["region"].alias("highest_region"),
        F.min(order)["region"].alias("lowest_region"),
        (F.max("variance") - F.min("variance")).alias("variance_spread"),
    )


def segment_pivot(view: DataFrame, band: str, segment: str, segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """Deals per band, one column per segment; a missing combination counts zero."""
    wide = view.groupBy("client_id", band).pivot(segment, list(segments)).agg(F.sum("deal_count"))
    return wide.na.fill(0, list(segments))


def outcome_counts(win_loss: DataFrame) -> DataFrame:
    """Deals by outcome, by loss reason and by competitor, as one long table."""
    def part(kind: str, label: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy("client_id", F.col(label).alias("label")).agg(F.sum("deal_count").alias("deals")).withColumn("kind", F.lit(kind))

    cited = win_loss.filter(F.col("competitor").isNotNull() & (F.col("competitor") != "None"))
    return (
        part("outcome", "deal_outcome", win_loss)
        .unionByName(part("loss_reason", "loss_reason", win_loss.filter(F.col("deal_outcome") == "Lost")))
        .unionByName(part("competitor", "competitor", cited))
    )


def top_competitors(win_loss: DataFrame, n: int = 3) -> DataFrame:
    """Most cited competitors by number of deals."""
    cited = win_loss.filter(F.col("competitor").isNotNull() & (F.col("competitor") != "None"))
    sums = cited.groupBy("client_id", "competitor").agg(F.sum("deal_count").alias("deals"))
    return top(sums, ["client_id"], [F.col("deals").desc(), F.col("competitor")], n)


def segment_cycle(velocity: DataFrame) -> DataFrame:
    """Average cycle per segment: plain mean of the view's rows, and weighted by deals."""
    weighted = ratio(fixed_sum(F.col("avg_days") * F.col("deal_count")), F.sum("deal_count"))
    return velocity.groupBy("client_id", "customer_segment").agg(mean("avg_days").alias("avg_days"), weighted.alias("weighted_avg_days"))


def governance_bands(view: DataFrame) -> DataFrame:
    return view.groupBy("client_id", "discount_band", "band_order", "required_approval").agg(
        F.sum("deal_count").alias("deal_count"), F.sum("override_count").alias("override_count")
    )


def governance_totals(view: DataFrame) -> DataFrame:
    senior = F.col("required_approval").isin("Director", "Executive")
    director = F.sum(F.when(senior, F.col("deal_count")).otherwise(0))
    whole = F.sum("deal_count")
    return view.groupBy("client_id").agg(
        whole.alias("total_deals"),
        director.alias("director_plus"),
        percent(director, whole).alias("director_plus_pct"),
        F.sum("override_count").alias("total_overrides"),
    )


def cohort_matrix(cohorts: DataFrame, n_cohorts: int = 8, n_months: int = 12) -> DataFrame:
    """Latest cohorts against the first revenue months, with intensity relative to the client's largest cell.

    Months are compared as text; the two windows see distinct months only.
    """
    latest = top(cohorts.select("client_id", "cohort_month").distinct(), ["client_id"], [F.col("cohort_month").desc()], n_cohorts, "cohort_rank")
    first = top(cohorts.select("client_id", "rev_month").distinct(), ["client_id"], [F.col("rev_month")], n_months, "month_rank")
    peak = cohorts.groupBy("client_id").agg(F.max("revenue").alias("peak"))
    grid = latest.join(first, "client_id")
    return (
        grid.join(cohorts, ["client_id", "cohort_month", "rev_month"], "left")
        .join(peak, "client_id")
        .select(
            "client_id", "cohort_month", "rev_month", "cohort_rank", "month_rank",
            F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
            (F.coalesce("revenue", F.lit(0.0)) / F.nullif("peak", F.lit(0.0))).alias("intensity"),
        )
    )


def cohort_heatmap(matrix: DataFrame, n_months: int = 12) -> DataFrame:
    """The matrix as one row per cohort with columns M1..Mn."""
    named = matrix.withColumn("m", F.concat(F.lit("M"), F.col("month_rank").cast("string")))
    return named.groupBy("client_id", "cohort_month").pivot("m", [f"M{i + 1}" for i in range(n_months)]).agg(F.max("revenue"))


def rep_top(perf: DataFrame, n: int = 10) -> DataFrame:
    """Best reps by bookings with their quota band."""
    attained = F.col("quota_attainment")
    return top(perf, ["client_id"], [F.col("bookings").desc(), F.col("rep")], n).select(
        "client_id", "rank", "rep", "bookings", "quota_attainment",
        F.when(attained < 80, "below 80").when(attained < 100, "80 to 100").when(attained >= 100, "100 and above").alias("quota_band"),
    )


def size_outcome_pivot(view: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    wide = view.groupBy("client_id", "size_band", "band_order").pivot("deal_outcome", list(outcomes)).agg(F.sum("deal_count"))
    return wide.na.fill(0, list(outcomes))


def large_deal_share(view: DataFrame, from_band: int = 3) -> DataFrame:
    """Share of value in deals of 25K and more."""
    large = fixed_sum(F.when(F.col("band_order") >= from_band, F.col("total_value")).otherwise(F.lit(0.0)))
    whole = fixed_sum("total_value")
    return view.groupBy("client_id").agg(
        large.alias("large_value"), whole.alias("total_value"), percent(large, whole).alias("large_value_pct")
    )


def competitor_list(intel: DataFrame, n: int = 10) -> DataFrame:
    order = [F.col(c) for c in ("competitor_name", "own_product_sku", "price_type", "market_segment", "geography", "confidence_level")]
    return top(intel, ["client_id"], order, n)


def rebate_by_customer(view: DataFrame, n: int = 10) -> DataFrame:
    sums = view.groupBy("client_id", "customer_id", "customer_name").agg(
        fixed_sum("total_accrued").alias("accrued"), fixed_sum("total_claimed").alias("claimed"),
        fixed_sum("total_paid").alias("paid"), fixed_sum("leakage").alias("leakage"), F.count(F.lit(1)).alias("rows"),
    )
    return top(sums, ["client_id"], [F.col("accrued").desc(), F.col("customer_id")], n)


def rebate_totals(view: DataFrame) -> DataFrame:
    return view.groupBy("client_id").agg(fixed_sum("leakage").alias("total_leakage"), mean("payout_rate").alias("avg_payout_rate"))


def serve_cost_top(view: DataFrame, n: int = 12) -> DataFrame:
    """Costliest customers over all their periods."""
    sums = view.groupBy("client_id", "customer_id", "customer_name").agg(fixed_sum("total_cost_to_serve").alias("total_cost"))
    return top(sums, ["client_id"], [F.col("total_cost").desc(), F.col("customer_id")], n)


def serve_cost_by_segment(view: DataFrame) -> DataFrame:
    return view.groupBy("client_id", "customer_segment").agg(mean("total_cost_to_serve").alias("avg_cost"))


def promotion_totals(view: DataFrame) -> DataFrame:
    """Totals over the promotions that sold anything."""
    lift, cost = fixed_sum("revenue_lift"), fixed_sum("promotional_cost")
    return view.filter(F.col("promo_revenue") > 0).groupBy("client_id").agg(
        lift.alias("total_lift"),
        cost.alias("total_cost"),
        percent(lift - cost, cost).alias("overall_roi_pct"),
        F.count_if(F.col("performance_band") != "Below Baseline").alias("winners"),
    )


def portfolio(clients: DataFrame) -> DataFrame:
    return clients.agg(
        F.count(F.lit(1)).alias("clients"),
        F.count_if(F.col("silver_status") == "complete").alias("ready_clients"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
    )


def readiness(clients: DataFrame) -> DataFrame:
    """Readiness flags done per client and the labels still missing."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c, _ in READINESS]
    missing = F.array_compact(F.array(*[F.when(~f, F.lit(label)) for f, (_, label) in zip(flags, READINESS)]))
    labels = F.array_join(missing, ", ")
    return clients.select(
        "client_id",
        sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")).alias("done"),
        F.lit(len(READINESS)).alias("of"),
        F.when(labels == "", "All clear").otherwise(labels).alias("missing"),
        "total_records",
    )
