"""Tables of a layer: versioned parquet folders with one slice per client."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TABLES
from ..operators.ordering import keep_last

# Words in the names of folders that hold no table, and the suffix silver tables carry.
NOT_TABLES = ("All_Tables", "reconciliation", "cleaning_log", "pipeline_metadata")
_POINTERS = "_pointers"
_POINTER_SCHEMA = "client_id string, version long, columns string"


def table_name(folder: str) -> str:
    return folder[: -len("_silver")] if folder.lower().endswith("_silver") else folder


class TableStore:
    """Parquet tables under ``root``/table/version=N/client_id=...

    A write puts the touched clients' slices into a new version folder and then adds one pointer row per slice;
    readers follow each client's newest pointer. Nothing being read is ever overwritten, a failed write leaves nothing
    readers can see, and a retry replaces its own leftovers. Two writers to one table must not run at the same time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(_POINTER_SCHEMA).parquet(f"{self.root}/{_POINTERS}/{table}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], _POINTER_SCHEMA)
            raise

    def versions(self, table: str) -> DataFrame:
        """Newest version per client, with its columns."""
        return self._pointers(table).groupBy("client_id").agg(
            F.max("version").alias("version"), F.max_by("columns", "version").alias("columns")
        )

    def exists(self, table: str) -> bool:
        return not self._pointers(table).isEmpty()

    def read(self, table: str, client_id: str | None = None) -> DataFrame:
        """Current rows of all clients or of one.

        Only folders of versions that some client still reads are listed, one per write, and of those only the current
        clients' slices are read: one client by its folder, all by a join with the pointers that prunes folders at run time.
        """
        current = self.versions(table)
        if client_id is not None:
            current = current.filter(F.col("client_id") == client_id)
        # A table has few different column lists, whatever the number of clients.
        layouts = [json.loads(r[0]) for r in current.select("columns").distinct().collect()]
        if not layouts:
            raise ValueError(f"table {table} has no rows for {client_id or 'any client'}")
        fields: dict[str, T.StructField] = {}
        for layout in layouts:
            for f in T.StructType.fromJson(layout).fields:
                fields.setdefault(f.name, f)
        schema = T.StructType([*fields.values(), T.StructField("version", T.LongType()), T.StructField("client_id", T.StringType())])
        base = f"{self.root}/{table}"
        folders = [f"{base}/version={r[0]}" for r in current.select("version").distinct().collect() if self._has(f"{base}/version={r[0]}")]
        if not folders:
            return self.spark.createDataFrame([], schema).select("client_id", *fields)
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*folders)
        if client_id is not None:
            rows = rows.filter(F.col("client_id") == client_id)
        else:
            rows = rows.join(current.select("client_id", "version"), ["client_id", "version"], "left_semi")
        return rows.select("client_id", *fields)

    def _file_system(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _has(self, folder: str) -> bool:
        files, path = self._file_system(folder)
        return files.exists(path)

    def drop_old_versions(self, table: str) -> list[int]:
        """Delete the versions no client reads any more; returns them. No reader or writer may be at work on the table."""
        every = {r[0] for r in self._pointers(table).select("version").distinct().collect()}
        old = sorted(every - {r[0] for r in self.versions(table).select("version").distinct().collect()})
        for version in old:
            files, path = self._file_system(f"{self.root}/{table}/version={version}")
            files.delete(path, True)
        return old

    def replace(self, table: str, df: DataFrame, client_ids: Sequence[str] = ()) -> None:
        """New content of every client slice ``df`` has rows for. Clients in ``client_ids`` without rows become empty."""
        version = (self._pointers(table).agg(F.max("version")).first()[0] or 0) + 1
        layout = T.StructType([f for f in df.schema.fields if f.name != "client_id"]).json()
        folder = f"{self.root}/{table}/version={version}"
        # Each client's rows come from few tasks, a large client's from as many as its size needs.
        df.hint("rebalance", "client_id").write.mode("overwrite").partitionBy("client_id").parquet(folder)
        try:
            only_client = T.StructType([T.StructField("client_id", T.StringType())])
            written = self.spark.read.schema(only_client).parquet(folder).select("client_id").distinct()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            written = self.spark.createDataFrame([], "client_id string")
        if client_ids:
            written = written.union(self.spark.createDataFrame([(c,) for c in client_ids], "client_id string")).distinct()
        pointers = written.select("client_id", F.lit(version).cast("long").alias("version"), F.lit(layout).alias("columns"))
        pointers.coalesce(1).write.mode("append").parquet(f"{self.root}/{_POINTERS}/{table}")

    def upsert(self, table: str, source: DataFrame, keys: Sequence[str], order=None) -> None:
        """Insert new keys and overwrite known ones; only the slices of clients in ``source`` are rewritten."""
        current = None
        if self.exists(table):
            current = self.read(table).join(source.select("client_id").distinct(), "client_id", "left_semi")
        self.replace(table, merge_into(current, source, keys, order))

    def append(self, table: str, df: DataFrame, load: str) -> None:
        """Records of one load, such as run and lineage records, beside those of others; the same load again replaces its own."""
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/load={load}")


def merge_into(target: DataFrame | None, source: DataFrame, keys: Sequence[str], order=None) -> DataFrame:
    """Rows of ``target`` whose key is not in ``source``, plus the last ``source`` row per key."""
    last = keep_last(source, keys, order if order is not None else F.struct(*[F.col(f"`{c}`") for c in source.columns]))
    if target is None:
        return last
    return target.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def in_load_order(names: Sequence[str]) -> list[str]:
    """Dimensions, then facts, then the rest; catalog order inside."""
    catalog = list(TABLES)
    def place(n: str) -> tuple[int, int, str]:
        group = 0 if n.startswith("dim_") else 1 if n.startswith("fact_") else 2
        return group, catalog.index(n) if n in catalog else len(catalog), n
    return sorted(names, key=place)


def read_layer(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Plain parquet tables of a layer by name, leaving out books, reports, logs and empty tables."""
    out = {}
    for n in sorted(names):
        if any(word in n for word in NOT_TABLES):
            continue
        df = spark.read.parquet(f"{root.rstrip('/')}/{n}")
        if not df.isEmpty():
            out[table_name(n)] = df
    return out


def union_records(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with differing columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
