"""Bronze tables -> cleaned, deduplicated, enriched silver tables with log and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as c
from ..operators import enrich as e
from ..operators import entities, quality
from ..session import staged
from ..sources.tables import union_records

def to_silver(
    bronze: Mapping[str, DataFrame],
    merge_decisions: DataFrame | None = None,
    enrichment: DataFrame | None = None,
    min_score: float | None = None,
    positions: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(silver tables, cleaning log, reconciliation). Decisions and enrichment come in as tables.

    Tables with a ``_position`` column keep the last load of repeated deals and representatives; without one the
    largest row by value stays, so that the result is repeatable. The column ends here unless ``positions`` hands it on.
    Names of equal normal form become one, near ones only with a ``min_score``.
    """
    tables, logs = {}, []
    for name, df in bronze.items():
        cleaned, log = c.clean(df, name)
        tables[name] = staged(cleaned, "silver")
        logs.append(log)

    named = {n: t for n, t in tables.items() if "customer_name" in t.columns}
    if named:
        names = e.distinct_names(list(named.values())).select(F.col("customer_name").alias("name"))
        merges = staged(entities.merge_map(entities.name_groups(names), merge_decisions, min_score), "merges")
        for n, t in named.items():
            tables[n] = e.apply_merges(t, merges)
            logs.append(e.merge_counts(t, tables[n], n))

    for name, df in tables.items():
        order = F.col(c.POSITION) if c.POSITION in df.columns else F.struct(*[F.col(f"`{x}`") for x in df.columns])
        if "deal_opportunity" in name:
            df = e.dedup_deals(df, order)
        if "sales_rep" in name:
            df = e.dedup_reps(df, order)
        if "customer_dim" in name and enrichment is not None and "customer_name" in df.columns:
            df = e.enrich(df, enrichment)
        if ("transaction" in name or "fact" in name) and "revenue" in df.columns:
            df = e.flag_negative(df)
        if ("financial" in name or "p_and_l" in name) and "line_item" in df.columns:
            df = e.categorize(df)
        tables[name] = e.derive_discount(df)
    before, after = ({n: df.drop(c.POSITION) for n, df in ts.items()} for ts in (bronze, tables))
    return tables if positions else after, union_records(logs), quality.reconcile(before, after)
