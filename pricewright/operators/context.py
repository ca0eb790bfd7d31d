"""What is known about a client: merging sources by trust, and required fields."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

# Sources from most to least trusted, and the fields every client must have.
PRECEDENCE = ("team-entered", "extracted-from-file", "extracted-from-text", "inferred-from-data")
REQUIRED = ("company_name", "industry", "business_model", "revenue_range", "product_type", "engagement_goal")


#: Levels of nested objects a context file may have; more are reported, not followed.
DEPTH = 16


def flatten_json(files: DataFrame, text: str = "content", depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(facts, problems) of JSON documents in a text column; the other columns come along.

    Facts are (columns, field, value, seq): one row per leaf, ``field`` the names of the objects above it joined by dots,
    ``seq`` its place in the document. Arrays of plain values are one value, as JSON; of arrays of objects every element is
    followed, numbered from 0. Nulls are no facts. Problems are (columns, problem): texts that are no JSON object, and
    what lies deeper than ``depth``. Each level is one explode of the variants that are left, so the plan grows with the
    depth of the documents, not with their number.
    """
    keep = [c for c in files.columns if c != text]
    parsed = files.select(*keep, F.try_parse_json(text).alias("_node"))
    shape = F.schema_of_variant("_node")
    ill = parsed.where(F.col("_node").isNull() | ~shape.startswith("OBJECT")).select(*keep, F.lit("no JSON object").alias("problem"))
    level = parsed.where(shape.startswith("OBJECT")).select(*keep, F.lit(None).cast("string").alias("_path"), F.array().cast("array<long>").alias("seq"), "_node")
    spark, leaves, deeper = files.sparkSession, [], level
    for _ in range(depth):
        view = f"_level_{uuid.uuid4().hex}"
        deeper.createOrReplaceTempView(view)
        names = ", ".join(f"t.`{k}`" for k in keep)
        below = spark.sql(f"SELECT {names}, t._path, t.seq, e.pos, e.key, e.value AS _node FROM {view} t, LATERAL variant_explode(t._node) e")
        name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        below = below.select(*keep, F.concat_ws(".", "_path", name).alias("_path"), F.concat("seq", F.array(F.col("pos").cast("long"))).alias("seq"), "_node", F.schema_of_variant("_node").alias("_shape"))
        below = materialise(below.where("_shape != 'VOID'"))
        inner = F.col("_shape").startswith("OBJECT<") & (F.col("_shape") != "OBJECT<>") | F.col("_shape").startswith("ARRAY<OBJECT")
        leaves.append(below.where(~inner).select(*keep, F.col("_path").alias("field"), _plain("_node").alias("value"), "seq"))
        deeper = below.where(inner).select(*keep, "_path", "seq", "_node")
        if deeper.isEmpty():
            break
    else:
        ill = ill.unionByName(deeper.select(*keep, F.format_string("deeper than %d levels: %s", F.lit(depth), "_path").alias("problem")))
    facts = leaves[0]
    for more in leaves[1:]:
        facts = facts.unionByName(more)
    return facts, ill


def _plain(node: str) -> Column:
    """A leaf as text: strings without quotes, all else as JSON."""
    return F.coalesce(F.when(F.schema_of_variant(node) == "STRING", F.variant_get(node, "$", "string")), F.to_json(node))


def read_context(spark: SparkSession, root: str, source: str = "extracted-from-file", pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(facts for ``merge_context``, problems) of the context files below ``root``, whose folder is the client's id.

    A file holds one JSON object. ``field`` values may be given plainly or as an object of ``value`` and ``source``; a plain
    value has the ``source`` named here. Facts are numbered in the order of file and place.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    files = raw.select(F.element_at(parts, -2).alias("client_id"), F.col("path").alias("file"), F.col("content").cast("string").alias("content"))
    facts, problems = flatten_json(files)
    stated = facts.where(F.col("field").rlike(r"\.(value|source)$")).withColumn("kind", F.regexp_extract("field", r"\.(value|source)$", 1))
    stated = stated.withColumn("field", F.regexp_replace("field", r"\.(value|source)$", ""))
    both = stated.groupBy("client_id", "file", "field").agg(
        F.max(F.when(F.col("kind") == "value", F.col("value"))).alias("value"), F.max(F.when(F.col("kind") == "source", F.col("value"))).alias("source"), F.min("seq").alias("seq"))
    plain = facts.where(~F.col("field").rlike(r"\.(value|source)$")).withColumn("source", F.lit(None).cast("string"))
    every = plain.unionByName(both.where(F.col("value").isNotNull()))
    return every.select("client_id", "field", "value", F.coalesce("source", F.lit(source)).alias("source"), F.struct("file", "seq").alias("seq")), problems


def trust(source) -> object:
    """0 for the most trusted source; a file's own name may follow 'extracted-from-'."""
    rank = F.when(source == PRECEDENCE[0], 0).when(source == PRECEDENCE[2], 2).when(source == PRECEDENCE[3], 3)
    return rank.when(source.startswith("extracted-from-"), 1).otherwise(len(PRECEDENCE))


def _filled(value):
    return F.coalesce(~F.trim(value).isin("", "[]"), F.lit(False))


def merge_context(facts: DataFrame) -> DataFrame:
    """(client_id, field, value, source, alternatives) from (client_id, field, value, source, seq).

    The most trusted source wins, the earliest within one source; values that lost stay as alternatives.
    Every field is decided by a maximum, so a field stated very often is no hot spot; alternatives are distinct.
    """
    known = facts.filter(_filled(F.col("value"))).withColumn("_rank", F.struct(trust(F.col("source")).alias("t"), F.col("seq"), F.col("value")))
    key = ["client_id", "field"]
    won = known.groupBy(*key).agg(F.min_by(F.struct("value", "source"), "_rank").alias("w")).select(*key, F.col("w.value").alias("value"), F.col("w.source").alias("source"))
    other = known.select(*key, F.col("value").alias("_other")).distinct().join(won.select(*key, "value"), key)
    lost = other.filter(F.col("_other") != F.col("value")).groupBy(*key).agg(F.count(F.lit(1)).alias("alternatives"))
    return won.join(lost, key, "left").withColumn("alternatives", F.coalesce("alternatives", F.lit(0)))


def alternatives(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Values that lost, one row each with the most trusted source stating them."""
    key = ["client_id", "field"]
    stated = facts.filter(_filled(F.col("value"))).groupBy(*key, "value").agg(
        F.min_by("source", F.struct(trust(F.col("source")).alias("t"), F.col("seq"))).alias("source")
    )
    return stated.join(merged.select(*key, "value"), [*key, "value"], "left_anti")


def missing_fields(merged: DataFrame, clients: DataFrame) -> DataFrame:
    """Required fields each client lacks, as sorted text; empty when complete."""
    required = F.array(*[F.lit(f) for f in REQUIRED])
    have = merged.filter(F.col("field").isin(*REQUIRED) & _filled(F.col("value"))).select("client_id", "field").distinct()
    sets = have.groupBy("client_id").agg(F.collect_set("field").alias("have"))
    lacking = F.array_except(required, F.coalesce("have", F.array().cast("array<string>")))
    return clients.select("client_id").distinct().join(sets, "client_id", "left").select(
        "client_id", F.size(lacking).alias("missing"), F.array_join(lacking, ", ").alias("fields"), (F.size(lacking) == 0).alias("is_complete")
    )
