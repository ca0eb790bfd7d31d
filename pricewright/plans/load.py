"""Silver tables -> canonical star schema in the store, with lineage and client records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TABLES
from ..operators import classify as k
from ..operators import quality
from ..operators.clean import POSITION
from ..operators.keys import content_keys
from ..operators.ordering import keep_last
from ..operators.reshape import to_canonical
from ..session import staged
from ..sources.tables import TableStore, in_load_order, union_records

ORDER = "_order"
#: What bronze tables carry as the place of a row in its source.
POSITION_TYPE = "struct<file:string,sheet:string,block:bigint,seq:bigint,part:int>"


def classify_tables(names: list[str], spark, decisions: Mapping[str, str] | None = None, whole_words: bool = True) -> dict[str, str]:
    """Canonical target per table name; outside decisions fill what the rules leave open. A handful of names."""
    found = k.classify(spark.createDataFrame([(n,) for n in names], "name string"), whole_words=whole_words).collect()
    targets = {r["name"]: r["target_table"] or (decisions or {}).get(r["name"]) for r in found}
    return {n: t for n, t in targets.items() if t in TABLES}


def column_map(df: DataFrame, target: str, decisions: Mapping[str, str] | None = None, benefits: bool = False) -> dict[str, str]:
    """Source column -> canonical column: rules first, then outside decisions for the rest. A handful of headers.

    ``benefits`` adds the spellings of the benefits-management domain.
    """
    spark = df.sparkSession
    columns = spark.createDataFrame([("t", target, c) for c in df.columns], "source string, target_table string, column string")
    mapped = k.map_columns(columns, k.benefits_rules() if benefits else None)
    if decisions:
        told = spark.createDataFrame([("t", target, a, b) for a, b in decisions.items()], "source string, target_table string, column string, canonical string")
        mapped = k.apply_decisions(mapped, told)
    return {r["column"]: r["canonical"] for r in mapped.collect() if r["canonical"]}


def load(
    store: TableStore,
    silver: Mapping[str, DataFrame],
    client_id: str,
    client_name: str,
    industry: str | None = None,
    tables: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    dry_run: bool = False,
    benefits: bool = False,
) -> DataFrame:
    """Write every table the rules or decisions place, dimensions first; return one summary row per source table.

    Natural keys are merged: of rows with one key the one of the last source table stays, in a source the last by its
    ``_position``, where it has one. Generated keys are made over all sources of a table and replace the client's slice. Rows
    without a required value go to the table ``rejected``, as JSON with their source. A dry run counts and writes nothing.

    What is recorded about a load is kept under a mark of its content: the same rows loaded again, also after a failure
    half-way, leave one set of records. Terminations are checked against the book of business where both are there.
    """
    spark, marks = store.spark, []
    targets = classify_tables(list(silver), spark, tables)
    summary, total = [], 0
    by_target: dict[str, list[tuple[str, DataFrame, dict[str, str]]]] = {}
    for name, target in targets.items():
        mapping = column_map(silver[name], target, (columns or {}).get(name), benefits)
        by_target.setdefault(target, []).append((name, silver[name], mapping))
    loaded = []
    for target in in_load_order(list(by_target)):
        spec, parts = TABLES[target], []
        for place, (name, df, mapping) in enumerate(by_target[target]):
            good, bad = to_canonical(df, spec, mapping, client_id, keep=[POSITION], keyed=False)
            good, bad = staged(good, "good"), staged(bad.drop(POSITION), "rejected")
            counts, mark = zip(*[content_mark(df) for df in (good, bad)])
            marks.append((name, target, *mark))
            summary.append((name, target, *counts, mapping))
            total += counts[0]
            position = F.col(POSITION) if POSITION in good.columns else F.lit(None).cast(POSITION_TYPE)
            order = F.struct(F.lit(place).alias("source"), position.cast(POSITION_TYPE).alias("position"))
            parts.append(good.drop(POSITION).withColumn(ORDER, order))
            if counts[1] and not dry_run:
                store.append("rejected", rejected(bad, client_id, name, target), load_mark(client_id, marks[-1:]))
        if dry_run:
            continue
        rows = union_records(parts)
        if spec.generated_key:
            store.replace(target, content_keys(rows.drop(ORDER)), [client_id])
        else:
            last = keep_last(rows, spec.merge_key, F.col(ORDER)).drop(ORDER)
            store.upsert(target, last, spec.merge_key)
        loaded.append(target)
    result = spark.createDataFrame(
        summary, "source string, target_table string, rows long, rejected long, mapping map<string,string>"
    )
    if not dry_run:
        mark = load_mark(client_id, marks)
        store.append("meta_data_source", lineage(result, client_id), mark)
        store.append("meta_run", run_record(result, client_id, "load"), mark)
        found, missing = check_load(store, client_id, loaded)
        grade = quality.overall_grade(found).first()["grade"] if found is not None else None
        unlinked = termination_links(silver, client_id)
        for name, report in (("quality_report", found), ("fk_report", missing), ("termination_report", unlinked)):
            if report is not None:
                store.append(name, report.withColumn("checked_at", F.current_timestamp()), mark)
        store.upsert("clients", client_row(spark, client_id, client_name, industry, total, len(loaded), grade), ["client_id"])
    return result


def content_mark(df: DataFrame) -> tuple[int, str]:
    """(rows, a mark of their content whatever their order), in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("*")).alias("x"), F.sum(F.xxhash64(F.lit(1), "*").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], f"{row['n']}/{row['x']}/{row['s']}"


def load_mark(client_id: str, marks: list[tuple]) -> str:
    return hashlib.md5(json.dumps([client_id, *marks]).encode()).hexdigest()


def termination_links(silver: Mapping[str, DataFrame], client_id: str) -> DataFrame | None:
    """Terminated clients that the book of business doesn't know; None where one of the two tables is missing."""
    ended = next((df for n, df in silver.items() if "termination" in n and "client_name" in df.columns), None)
    book = next((df for n, df in silver.items() if "book_of_business" in n and "client_name" in df.columns), None)
    if ended is None or book is None:
        return None
    return quality.unlinked_terminations(ended, book).select(F.lit(client_id).alias("client_id"), "client_name", "rows")


#: Dimensions and the key by which facts refer to them.
PARENTS = {"dim_customer": "customer_id", "dim_product": "product_sku", "dim_sales_rep": "sales_rep_id", "dim_contract": "contract_id"}


def check_load(store: TableStore, client_id: str, loaded: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(quality scores of the loaded tables, keys of loaded facts that no stored dimension has)."""
    dims = {d: store.read(d, client_id) for d in PARENTS if store.exists(d) and not store.versions(d).filter(F.col("client_id") == client_id).isEmpty()}
    scores, missing = [], []
    for target in loaded:
        spec, rows = TABLES[target], store.read(target, client_id)
        known = {d: k for d, k in PARENTS.items() if target.startswith("fact_") and d in dims and k in rows.columns}
        checked = [c for c in (spec.required or spec.columns[:1]) if c in rows.columns]
        scores.append(quality.quality_score(rows, target, checked, [c for c in spec.key if c in rows.columns], F.lit(True), {k: dims[d] for d, k in known.items()}))
        missing += [
            quality.orphans(rows, dims[d], ["client_id", k], target, d).select("fact", "dim", "client_id", F.col(k).cast("string").alias("key"), "rows") for d, k in known.items()
        ]
    return (union_records(scores) if scores else None), (union_records(missing) if missing else None)


def lineage(summary: DataFrame, client_id: str) -> DataFrame:
    """One row per loaded source table."""
    now = F.current_timestamp()
    return summary.select(
        F.concat_ws("_", F.lit(client_id), "source", F.unix_timestamp(now).cast("string")).alias("data_source_id"),
        F.lit(client_id).alias("client_id"),
        F.col("source").alias("source_file_name"),
        F.when(F.col("target_table").contains("revenue"), "period_aggregate").alias("grain_type"),
        now.alias("load_timestamp"),
        F.col("rows").alias("row_count"),
        F.col("mapping").alias("mapping_config_json"),
        F.when(F.col("rejected") == 0, "passed").when(F.col("rows") > 0, "partial").otherwise("failed").alias("validation_status"),
    )


def client_row(spark, client_id: str, client_name: str, industry: str | None, records: int, tables: int, grade: str | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(client_id).alias("client_id"),
        F.lit(client_name).alias("client_name"),
        F.lit(industry or "Unknown").alias("industry"),
        F.lit("complete").alias("bronze_status"),
        F.lit("complete").alias("silver_status"),
        F.lit("pending").alias("gold_status"),
        F.lit(records).cast("long").alias("total_records"),
        F.lit(tables).cast("int").alias("total_tables"),
        F.lit(grade).cast("string").alias("data_quality_grade"),
        F.current_timestamp().alias("last_run_at"),
    )


def rejected(bad: DataFrame, client_id: str, source: str, target: str) -> DataFrame:
    """Rows without a required value, for the append-only ``rejected`` table."""
    return bad.select(
        F.lit(client_id).alias("client_id"), F.lit(source).alias("source"), F.lit(target).alias("target_table"),
        F.to_json(F.struct("*")).alias("row"), F.current_timestamp().alias("rejected_at"),
    )


def run_record(summary: DataFrame, client_id: str, stage: str) -> DataFrame:
    """Rows per table of one run, for the append-only ``meta_run`` table."""
    return summary.select(
        F.lit(client_id).alias("client_id"), F.lit(stage).alias("stage"), F.col("source").alias("table"), "rows", "rejected",
        F.current_timestamp().alias("run_at"),
    )


def write_layer(store: TableStore, tables: Mapping[str, DataFrame], client_id: str, stage: str) -> DataFrame:
    """Write a client's bronze or silver tables as versioned slices; returns the run record, also kept in ``meta_run``.

    A later step reads the layer from the store, so a failed load does not repeat what came before.
    """
    counts = []
    for name, df in tables.items():
        rows = df.withColumn("client_id", F.lit(client_id))
        store.replace(f"{stage}_{name}", rows, [client_id])
        counts.append((name, store.read(f"{stage}_{name}", client_id).count(), 0))
    record = run_record(store.spark.createDataFrame(counts, "source string, rows long, rejected long"), client_id, stage)
    store.append("meta_run", record, load_mark(client_id, [stage, *counts]))
    return record


def read_client_layer(store: TableStore, names: list[str], client_id: str, stage: str) -> dict[str, DataFrame]:
    return {n: store.read(f"{stage}_{n}", client_id).drop("client_id") for n in names}
