"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE = "[\\x20\\x09-\\x0D]+"
#: The same characters, for trimming.
SPACES = " \t\n\x0b\x0c\r"
#: Null ids sort after all others.
LAST_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not made yet, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one fixed result that survives lost executors."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, keys: list[str], name: str = "buckets") -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys``, sorted, and read it back.

    There are as many buckets as shuffle partitions, so joins and aggregates on ``keys`` read it in place, without a shuffle,
    and a result of theirs is written without one.
    """
    spark, called = df.sparkSession, f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", shared_folder(spark, name)).saveAsTable(called)
    return spark.table(called)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, separated by ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """``size(words(text))`` without copying the words that matter only at the two ends."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def hash_pair(*values: Column) -> tuple[Column, Column]:
    """128 bits as two independently seeded 64-bit hashes."""
    return F.xxhash64(*values), F.xxhash64(F.lit(7919), *values)
