"""Surrogate keys that are contiguous, repeatable and made without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import real_name
from .ordering import running

# Number formats of the keys, and the widths of the benefits-management variant.
KEY_FORMATS = {"TXN": "%06d", "DEAL": "%04d", "CTR": "%04d", "TERM": "%05d", "CUST": "%04d", "SKU": "%04d", "REP": "%04d", "CLI": "%04d"}
BENEFITS_FORMATS = {**KEY_FORMATS, "DEAL": "%05d"}

# Rows one slice of a numbered table may hold.
SLICE_ROWS = 500_000

# Copies of one row written by one task.
COPIES_PER_TASK = 100_000


def key_text(prefix: Column, kind: str, number: Column, formats: dict[str, str] = KEY_FORMATS) -> Column:
    """PREFIX-KIND-0001; numbers beyond the width keep all their digits."""
    return F.concat_ws("-", prefix, F.lit(kind), F.format_string(formats[kind], number))


def row_position(*parents: str, sequence: str = "seq") -> Column:
    """Slice number for tables that know their position: parent columns, then blocks of the sequence."""
    return F.struct(*[F.col(p) for p in parents], F.floor(F.col(sequence) / SLICE_ROWS).alias("part"))


def sequence_keys(
    df: DataFrame,
    out: str,
    kind: str,
    prefix: Column,
    order: Sequence[str],
    keys: Sequence[str] = (),
    chunk: Column | None = None,
    formats: dict[str, str] = KEY_FORMATS,
) -> DataFrame:
    """Number rows 1, 2, ... per ``keys`` in ``order`` and write them as text keys."""
    numbered = running(df, list(keys), [F.col(c) for c in order], number="_number", chunk=chunk)
    return numbered.withColumn(out, key_text(prefix, kind, F.col("_number"), formats)).drop("_number")


def dictionary(names: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct real names with their rank 1, 2, ... in alphabetical order per ``keys``."""
    clean = names.select(*keys, real_name(name).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    return running(clean, list(keys), [F.col("_name")], number="_rank")


def dictionary_keys(
    df: DataFrame,
    name: str,
    out: str,
    kind: str,
    prefix: Column,
    keys: Sequence[str] = (),
    universe: DataFrame | None = None,
    formats: dict[str, str] = KEY_FORMATS,
) -> DataFrame:
    """Key per distinct name; rows without a real name get ''.

    ``universe`` holds the names of all tables of a client, so that one customer has one key everywhere; without it
    the names of ``df`` alone are numbered.
    """
    ranks = dictionary(df if universe is None else universe, name, keys)
    named = df.withColumn("_name", real_name(name))
    joined = named.join(ranks, [*keys, "_name"], "left")
    key = F.when(F.col("_rank").isNull(), F.lit("")).otherwise(key_text(prefix, kind, F.col("_rank"), formats))
    return joined.withColumn(out, key).select(*[c for c in df.columns if c != out], out)


def content_keys(df: DataFrame, out: str = "id") -> DataFrame:
    """Key from a row's content and its copy number: the same input always gives the same keys.

    Copies are counted, not listed; rows with very many are written out again in portions spread over tasks.
    """
    names = df.columns
    content = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    counted = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_hash", F.sha2(content, 256))
    portion = F.explode(F.expr(f"sequence(1L, _copies, {COPIES_PER_TASK}L)"))
    few = counted.filter(F.col("_copies") <= COPIES_PER_TASK).withColumn("_first", F.lit(1).cast("long"))
    many = counted.filter(F.col("_copies") > COPIES_PER_TASK).withColumn("_first", portion).repartition("_hash", "_first")
    last = F.least(F.col("_copies"), F.col("_first") + COPIES_PER_TASK - 1)
    rows = few.unionByName(many).withColumn("_copy", F.explode(F.sequence("_first", last)))
    key = F.sha2(F.concat_ws("#", "_hash", F.col("_copy").cast("string")), 256)
    return rows.select(key.alias(out), *[F.col(f"`{n}`") for n in names])
