"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import running
from .common import staged, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Documents that a slice of the shuffled order, or of the virtual time, has about.
SLICE_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words per source, from rows (source, size); one row per source, so the windows here are small.

    Sources ordered by code point, null last, take the weights in turn. Together the targets are all words. A target
    stops at ``max_repeats`` times its source's size, and what it leaves is shared again by weight: the level at which
    capped sources and level x weight of the others add up to the total is found from the sources in order of cap / weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("srank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("srank") - 1, F.lit(len(weights))) + 1)
    capped = ranked.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "srank")
    upto, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(upto), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levels = capped.withColumn("level", level)
    # The level at the first source that it doesn't cap holds for all after it.
    free = levels.where(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "srank")).alias("at"))
    target = F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))
    return levels.join(F.broadcast(free)).select("source", "srank", "source_size", target.alias("target"))


def place(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A document's place in the shuffled order: a seeded hash of id and text, so that only equal rows share it."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS, seed: str = SEED,
) -> DataFrame:
    """How often each document is taken so that the sources' words come to their targets.

    A source's documents are shuffled by a seeded hash of id and text; pass e over them follows pass e - 1. A copy's virtual finish
    time is the words of its source up to it, divided by the source's target. All copies are ordered by finish time
    and taken while their words fit into the total budget, the words of all documents. Both running sums go over
    ordered slices of a few thousand documents, whatever their number, so neither a source nor the whole order, nor the rows of
    one id or of none, meet in one task. The order is total but for equal rows, which weigh the same: reruns agree.

    Returns one row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, place. A null text has size 0; a
    null source is a source; rows that repeat count each for itself. Documents of size 0 take their place in the order
    and are taken with 0 words; a source without words has target 0, and its documents none. An empty table gives an empty one.
    """
    sizes = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        place(F.col(doc_id), F.col(text), seed).alias("u"),
    ), "sizes")
    goal = staged(targets(sizes, weights, max_repeats).coalesce(1), "targets")
    placed = sizes.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Hexadecimal digits of the place that a slice is known by; seven make 2^28 slices.
    digits = min(7, max(1, math.ceil(math.log(max(1, sizes.count()) / SLICE_ROWS, 16))))
    cut = F.conv(F.substring("u", 1, digits), 16, 10).cast("int")
    queued = staged(running(placed, ["srank"], [F.col("u"), F.col("doc_id")], {"cum": F.col("size")}, "n", cut), "queue")
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(max_repeats), F.ceil(_turns()).cast("int"))))
    copies = queued.where("source_size > 0").select("srank", "n", "size", "cum", "source_size", "target", F.explode(passes).alias("e"))
    copies = copies.select("srank", "n", "e", "size", _finish("e").alias("finish"))
    order = [F.col(c) for c in ("finish", "srank", "e", "n")]
    tick = F.floor(F.col("finish") * 16**digits).cast("long")
    passed = running(copies, [], order, {"spent": F.col("size")}, chunk=tick)
    budget = goal.agg(F.sum("source_size").alias("budget"))
    last = staged(passed.join(F.broadcast(budget)).where("spent <= budget").agg(F.max(F.struct(*order)).alias("last")), "cut")
    taken = sum(
        F.when((F.col("source_size") > 0) & (F.lit(e) <= F.greatest(F.lit(1), F.ceil(_turns())))
               & (F.struct(_finish(F.lit(e)).alias("finish"), F.col("srank"), F.lit(e).alias("e"), F.col("n")) <= F.col("last")), 1).otherwise(0)
        for e in range(1, max_repeats + 1)
    )
    out = queued.join(F.broadcast(last)).withColumn("copies", taken)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("u").alias("place"))


def _finish(e):
    e = F.col(e) if isinstance(e, str) else e
    return F.try_divide((F.col("cum") + (e - 1) * F.col("source_size")).cast("double"), F.col("target"))


def _turns():
    return F.try_divide("target", "source_size")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixture itself: a document taken twice is there twice; its columns are those of ``docs``."""
    # Equal rows lie behind one another in the order, so that the budget may end between them: the first of them decides.
    times = mix(docs).groupBy(F.col("place").alias("_mix_place"), F.col("source").alias("_mix_source")).agg(F.max("copies").alias("_mix_copies")).where("_mix_copies > 0")
    same = (place(docs["doc_id"], docs["text"]) == F.col("_mix_place")) & docs["source"].eqNullSafe(F.col("_mix_source"))
    joined = docs.join(times, same)
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), "_mix_copies")).alias("_mix_pass")).drop("_mix_pass")


SQL = f"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS u
    FROM documents),
ranked AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS srank FROM sizes GROUP BY source),
capped AS (SELECT *, CASE (srank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {MAX_REPEATS} AS cap FROM ranked),
levels AS (
    SELECT *, cap / weight AS need, CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, srank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (ORDER BY cap / weight, srank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM capped),
goal AS (
    SELECT source, srank, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT level FROM levels WHERE level <= need ORDER BY need, srank LIMIT 1)) AS target FROM levels),
queued AS (
    SELECT doc_id, size, source_size, target, srank, sum(size) OVER w AS cum, row_number() OVER w AS n
    FROM sizes JOIN goal ON sizes.source IS NOT DISTINCT FROM goal.source WINDOW w AS (PARTITION BY srank ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING)),
copies AS (
    SELECT *, CAST(cum + (e - 1) * source_size AS DOUBLE) / target AS finish FROM queued, (SELECT unnest(range(1, {MAX_REPEATS} + 1)) AS e)
    WHERE source_size > 0 AND e <= greatest(1, ceil(target / source_size))),
spent AS (SELECT *, sum(size) OVER (ORDER BY finish, srank, e, n ROWS UNBOUNDED PRECEDING) AS spent FROM copies),
taken AS (SELECT srank, n, sum(size) AS taken FROM spent WHERE spent <= (SELECT sum(source_size) FROM ranked) GROUP BY srank, n)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queued LEFT JOIN taken USING (srank, n)
"""
