"""Per-client views over deals and opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import band, mean_of, money, num, percent, ratio, round_half_up, total

# Band edges and labels.
PRICE_EDGES = (500, 2000, 10000, 50000)
PRICE_LABELS = ("<$500", "$500–2K", "$2K–10K", "$10K–50K", ">$50K")
CYCLE_EDGES = (30, 60, 90, 120)
CYCLE_LABELS = ("0–30d", "31–60d", "61–90d", "91–120d", "120d+")
DISCOUNT_EDGES = (5, 10, 15, 20)
DISCOUNT_LABELS = ("<5%", "5–10%", "10–15%", "15–20%", ">20%")
APPROVAL = ("Self-Service", "Self-Service", "Manager", "Director", "Executive")
SIZE_EDGES = (5000, 25000, 100000, 500000)
SIZE_LABELS = ("<$5K", "$5K–25K", "$25K–100K", "$100K–500K", ">$500K")


def deals() -> Column:
    return F.count(F.lit(1))


def won(value: Column | str | None = None) -> Column:
    """Count, or exact sum of ``value``, over won deals."""
    is_won = F.col("deal_outcome") == "Won"
    if value is None:
        return F.count_if(is_won)
    return F.sum(F.when(is_won, money(value)).otherwise(money(F.lit(0))))


def deal_scorecard(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """Win rate over all deals, discount, deal count and won value per rep."""
    sums = facts.groupBy("client_id", "sales_rep_id").agg(
        deals().alias("deals"), won().alias("w"), mean_of("discount_pct").alias("avg_discount"), won("deal_value").alias("v")
    )
    names = reps.select("client_id", "sales_rep_id", "sales_rep_name")
    return sums.join(names, ["client_id", "sales_rep_id"], "left").select(
        "client_id",
        F.col("sales_rep_name").alias("rep"),
        percent("w", "deals").alias("win_rate"),
        "avg_discount",
        "deals",
        num("v").alias("revenue"),
    )


def price_band(facts: DataFrame) -> DataFrame:
    """Deals by band of the final price and segment."""
    b = band(money("final_price"), PRICE_EDGES, PRICE_LABELS)
    return (
        facts.groupBy("client_id", b.alias("b"), F.col("customer_segment").alias("segment"))
        .agg(
            deals().alias("deal_count"),
            total("final_price").alias("rev"),
            mean_of("final_price").alias("avg_price"),
            mean_of("discount_pct").alias("avg_discount_pct"),
        )
        .select(
            "client_id",
            F.col("b.label").alias("price_band"),
            F.col("b.rank").alias("band_order"),
            "segment",
            "deal_count",
            num("rev").alias("revenue"),
            "avg_price",
            "avg_discount_pct",
        )
    )


def win_loss(facts: DataFrame) -> DataFrame:
    """Deals by outcome; reason and competitor only where the deal was lost."""
    lost = F.col("deal_outcome") == "Lost"
    return facts.groupBy(
        "client_id",
        "deal_outcome",
        F.when(lost, F.col("loss_reason")).alias("loss_reason"),
        F.when(lost, F.col("competitor_cited")).alias("competitor"),
        "customer_segment",
    ).agg(
        deals().alias("deal_count"),
        num(total("deal_value")).alias("total_value"),
        mean_of("discount_pct").alias("avg_discount"),
        mean_of("sales_cycle_days").alias("avg_cycle_days"),
    )


def deal_velocity(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """Cycle length by segment, rep, outcome and cycle bucket."""
    b = band(num("sales_cycle_days"), CYCLE_EDGES, CYCLE_LABELS, closed="right")
    sums = facts.groupBy("client_id", "customer_segment", "sales_rep_id", "deal_outcome", b["label"].alias("cycle_bucket")).agg(
        deals().alias("deal_count"), mean_of("sales_cycle_days").alias("days"), mean_of("deal_value").alias("avg_deal_value")
    )
    names = reps.select("client_id", "sales_rep_id", "sales_rep_name")
    return sums.join(names, ["client_id", "sales_rep_id"], "left").select(
        "client_id",
        "customer_segment",
        F.col("sales_rep_name").alias("rep"),
        "deal_outcome",
        "cycle_bucket",
        "deal_count",
        round_half_up(F.col("days"), 1).alias("avg_days"),
        "avg_deal_value",
    )


def discount_governance(facts: DataFrame) -> DataFrame:
    """Deals by discount band and the approval the band calls for."""
    b = band(money("discount_pct"), DISCOUNT_EDGES, DISCOUNT_LABELS)
    approvals = F.array(*[F.lit(a) for a in APPROVAL])
    return (
        facts.groupBy("client_id", b.alias("b"), "customer_segment")
        .agg(
            deals().alias("deal_count"),
            F.count_if("override_flag").alias("override_count"),
            num(total("deal_value")).alias("total_value"),
            mean_of("deal_value").alias("avg_deal_value"),
        )
        .select(
            "client_id",
            F.col("b.label").alias("discount_band"),
            F.col("b.rank").alias("band_order"),
            F.element_at(approvals, F.col("b.rank")).alias("required_approval"),
            "customer_segment",
            "deal_count",
            "override_count",
            "total_value",
            "avg_deal_value",
        )
    )


def sales_rep_perf(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """Deals, win rate, bookings and quota attainment per rep."""
    is_won = F.col("deal_outcome") == "Won"
    sums = facts.groupBy("client_id", "sales_rep_id").agg(
        deals().alias("total_deals"),
        won().alias("won_deals"),
        F.count_if(F.col("deal_outcome") == "Lost").alias("lost_deals"),
        won("deal_value").alias("b"),
        mean_of("discount_pct").alias("avg_discount"),
        ratio(won("sales_cycle_days"), F.count(F.when(is_won, F.col("sales_cycle_days")))).alias("avg_cycle_days_won"),
    )
    people = reps.select("client_id", "sales_rep_id", "sales_rep_name", "territory", "segment_coverage", "tenure_months", "quota")
    return sums.join(people, ["client_id", "sales_rep_id"], "left").select(
        "client_id",
        "sales_rep_id",
        F.col("sales_rep_name").alias("rep"),
        "territory",
        "segment_coverage",
        "tenure_months",
        num("quota").alias("quota"),
        "total_deals",
        "won_deals",
        "lost_deals",
        percent("won_deals", "total_deals").alias("win_rate"),
        num("b").alias("bookings"),
        percent("b", "quota").alias("quota_attainment"),
        "avg_discount",
        "avg_cycle_days_won",
    )


def deal_size_dist(facts: DataFrame) -> DataFrame:
    """Deals by size band, segment and outcome."""
    b = band(money("deal_value"), SIZE_EDGES, SIZE_LABELS)
    return (
        facts.groupBy("client_id", b.alias("b"), "customer_segment", "deal_outcome")
        .agg(
            deals().alias("deal_count"),
            num(total("deal_value")).alias("total_value"),
            mean_of("discount_pct").alias("avg_discount"),
            mean_of("sales_cycle_days").alias("avg_cycle_days"),
        )
        .select("client_id", F.col("b.label").alias("size_band"), F.col("b.rank").alias("band_order"), "customer_segment",
                "deal_outcome", "deal_count", "total_value", "avg_discount", "avg_cycle_days")
    )
