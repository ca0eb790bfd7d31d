"""Chat formatting: collapse logged snapshots of growing conversations, then render what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, hash_pair, staged, table

SLICE = ["c", "slice"]


def segment(role: Column, text: Column) -> Column:
    """One turn between its marks; marks inside a text are broken up, so that a text cannot end its own turn."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    name = F.replace(F.coalesce(role, F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"), plain, F.lit("<|im_end|>\n"))


def maximal_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The turns of the conversations that are no prefix of another one, each with its rendered segment.

    A conversation is the list of its turns in order. One whose list begins another, longer one's is a snapshot of it and
    goes; of equal ones the smallest conv_id stays. Every prefix has a rolling hash: the 128-bit combination of its
    (position, role, text) hashes, so that it runs on over ordered slices and a conversation with a third of all turns is
    many slices. Prefixes are counted once per (length, hash), whatever the number of conversations that share them: a
    conversation goes if a longer one, or an equal one with a smaller id, has its full list as a prefix (anti-join).

    Returns conv_id, turn, position (from 1), n_turns, rendered. Turns are ordered by turn (null last), role and text hash; rows
    that repeat a turn in full are one turn. Null role renders as "unknown", null text as an empty one; null and empty differ
    in the comparison. Turns without conv_id are one conversation, after all others. Other columns are ignored.
    """
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("role", "text")]
    h1, h2 = hash_pair(*marked)
    turns = conversations.select(
        F.coalesce(F.col(conv_id).cast("long"), F.lit(LAST_ID)).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST_ID)).alias("t"),
        F.col(role).alias("role"), F.col(text).alias("text"),
    ).distinct().withColumns({"h1": h1, "h2": h2})
    order = [F.col(x) for x in ("c", "t", "role", "h1", "h2")]
    cut = staged(turns.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "turns")
    inside = Window.partitionBy(*SLICE).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("rows"))
    starts = counts.select(
        *SLICE, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("c")).alias("n")
    )
    placed = cut.join(starts, SLICE).withColumn("pos", F.row_number().over(inside) + F.col("start"))
    ticked = placed.withColumns({"p1": F.xxhash64("pos", "h1"), "p2": F.xxhash64(F.lit(7919), "pos", "h2")})
    chained = staged(ticked.withColumns({p: F.bit_xor(p).over(inside) for p in ("p1", "p2")}), "prefixes")
    ends = chained.groupBy(*SLICE).agg(*[F.max_by(p, "pos").alias(p) for p in ("p1", "p2")])
    base = ends.select(*SLICE, *[F.coalesce(F.bit_xor(p).over(before), F.lit(0)).alias(f"base_{p}") for p in ("p1", "p2")])
    prefixes = chained.join(base, SLICE).withColumns({p: F.col(p).bitwiseXOR(F.col(f"base_{p}")) for p in ("p1", "p2")})
    key = ["pos", "p1", "p2"]
    shared = prefixes.groupBy(*key).agg(F.max("n").alias("longest"), F.min(F.when(F.col("n") == F.col("pos"), F.col("c"))).alias("first"))
    full = prefixes.where("pos = n").select("c", *key)
    snapshots = full.join(shared, key).where("longest > pos OR first < c").select("c")
    return chained.join(snapshots, "c", "left_anti").select(
        F.nullif("c", F.lit(LAST_ID)).alias("conv_id"), F.nullif("t", F.lit(LAST_ID)).alias("turn"), F.col("pos").cast("long").alias("position"),
        F.col("n").cast("long").alias("n_turns"), segment(F.col("role"), F.col("text")).alias("rendered"),
    )


def render(turns: DataFrame) -> DataFrame:
    """One row (conv_id, n_turns, chat) per conversation, from ``maximal_turns``. A conversation has to fit into a row."""
    parts = F.sort_array(F.collect_list(F.struct("position", "rendered")))
    return turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("chat"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return maximal_turns(table(spark, folder, "conversations"))


SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
    SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg(md5(coalesce('=' || role, '') || '|' || md5(coalesce('=' || text, ''))), ',') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text)),
best AS (SELECT position, prefix, max(n_turns) AS longest, min(conv_id) FILTER (n_turns = position) AS first FROM placed GROUP BY ALL),
snapshots AS (SELECT p.conv_id FROM placed p JOIN best USING (position, prefix) WHERE p.position = p.n_turns AND (longest > p.position OR first < p.conv_id))
SELECT conv_id, turn, position, n_turns,
    '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
FROM placed WHERE conv_id NOT IN (SELECT conv_id FROM snapshots)
"""
