"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, SPACES, bucketed, hash_pair, staged, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


class Runs:
    """Sorted runs (h1, h2, owner) in levels. A level that has ``fanout`` runs is merged into one run of the next level.

    A key is in one run only, as a batch adds just the keys no run has. A run lies in the shared folder in fixed ranges of
    the hash, sorted, so that a batch meets it in place: only the batch is shuffled, never what came before.
    """

    def __init__(self, fanout: int = 3):
        self.fanout, self.levels = fanout, {}

    def all(self) -> list[DataFrame]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def add(self, keys: DataFrame, level: int = 0, stored: bool = False) -> None:
        """A new run of ``keys``, which are written unless they are ``stored`` in ranges already."""
        runs = self.levels.setdefault(level, [])
        runs.append(keys if stored else bucketed(keys.repartition(*KEY), KEY, f"run{level}"))
        if len(runs) >= self.fanout:
            self.levels[level] = []
            self.add(reduce(DataFrame.union, runs), level + 1)


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 10, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """Keep a line of at least ``min_length`` code points only in the smallest doc_id that holds its key.

    Documents come in batches of rising doc_id. Each batch's keys are merge-joined with the runs of all earlier
    batches, which stay where they are: keys found there belong to an earlier document, the rest are anti-joined out and
    added as a run of their own. Line hashes have 128 bits; a hot line meets map-side combined minima, and its occurrences are split by the
    skew join. Texts are shuffled once, to meet the positions of their dropped lines.

    Returns one row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text. A null or empty text is one empty line.
    Rows that share a doc_id are one document. A null doc_id sorts last, and all such rows count as one document.
    An empty table gives an empty one. Other columns are ignored.
    """
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(doc_id).alias("given"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    lines = staged(
        rows.select("id", F.xxhash64("body").alias("version"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_length)
        .select("id", "version", "pos", *[h.alias(k) for h, k in zip(hash_pair(F.col("line")), KEY)]),
        "lines",
    )
    shares = [i / batches for i in range(1, batches)]
    found = lines.where(F.col("id") < LAST_ID).approxQuantile("id", shares, 0.01) if shares else []
    edges = [None, *sorted({int(c) for c in found if c < LAST_ID}), None]
    runs, dropped = Runs(fanout), []
    for low, high in zip(edges, edges[1:]):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("id") > low)
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        own = batch.groupBy(*KEY).agg(F.min("id").alias("own"), F.max("id").alias("high"))
        for i, run in enumerate(runs.all()):
            own = own.join(run.withColumnRenamed("owner", f"owner{i}"), KEY, "left")
        earlier = [F.col(f"owner{i}") for i in range(len(runs.all()))]
        prior = F.coalesce(*earlier, F.lit(None).cast("long"))
        own = bucketed(own.select(*KEY, "own", "high", prior.alias("prior")), KEY, "batch_keys")
        repeated = own.where(F.col("prior").isNotNull() | (F.col("high") > F.col("own")))
        owner = F.coalesce("prior", "own")
        dropped.append(
            batch.join(repeated.select(*KEY, owner.alias("owner")), KEY).where(F.col("owner") < F.col("id")).select("id", "version", "pos")
        )
        runs.add(own.where(F.col("prior").isNull()).select(*KEY, F.col("own").alias("owner")), stored=True)
    gone = reduce(DataFrame.union, dropped).groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
    none = F.array().cast("array<int>")
    joined = rows.withColumn("version", F.xxhash64("body")).join(gone, ["id", "version"], "left")
    split = joined.select("given", F.split("body", "\n", -1).alias("lines"), F.coalesce("gone", none).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return split.select(
        F.col("given").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
    FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
flagged AS (SELECT doc_id, pos, line, coalesce(owner < doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
