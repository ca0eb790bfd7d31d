"""Exact top-k by inner product: global score histograms, refined until each query's k-th value is known."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Rows of a tile: about so many queries are scored against about so many candidates in one task.
QUERIES, CANDIDATES = 2048, 8192
#: Components of a block at most; blocks of wide vectors have fewer rows.
TILE_CELLS = 1 << 21
#: Bins a histogram pass divides a query's range into.
BINS = 1024
#: Scores of one matrix product.
_CELLS = 1 << 22


def _matrix(column: pa.ChunkedArray, dims: int, kind) -> np.ndarray:
    """Rows of numbers; missing trailing components are 0."""
    out, at = np.zeros((len(column), dims), kind), 0
    for chunk in column.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        columns = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[at + np.repeat(np.arange(len(sizes)), sizes), columns] = chunk.flatten().to_numpy()
        at += len(sizes)
    return out


def _tiles(left: pa.Table, right: pa.Table, norm: float):
    """(query rows, scores, which count) of one tile, in pieces of bounded size.

    No product of two vectors, nor any part of it, is above ``norm``, so floats are exact up to 2^24 and 2^53; integers are beyond.
    """
    if not left.num_rows or not right.num_rows:
        return
    kind = np.float32 if norm < 1 << 24 else np.float64 if norm < 1 << 53 else np.int64
    dims = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (left, right) for c in t["vector"].chunks)
    q, c = _matrix(left["vector"], dims, kind), _matrix(right["vector"], dims, kind)
    own = left["rid"].to_numpy()[:, None] == right["rid"].to_numpy()[None, :]
    step = max(1, _CELLS // len(c))
    for i in range(0, len(q), step):
        yield slice(i, i + step), (q[i : i + step] @ c.T).astype(np.int64), ~own[i : i + step]


def _histogram(k: int, span: int, width: int, bins: int, norm: float, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """(rid, bin, n) of the scores in each query's range, from the highest filled bin down to where k are counted.

    Lower bins don't matter: k scores of this tile alone are above them, so the k-th value lies in none of them.
    """
    rid, low = left["rid"].to_numpy(), left["low"].to_numpy()
    columns: list[list] = [[], [], []]
    for rows, scores, there in _tiles(left, right, norm):
        shifted = scores - low[rows, None]
        inside = there & (shifted >= 0) & (shifted < span)
        row, at = np.nonzero(inside)
        cells = row * bins + (shifted[row, at] // width).astype(np.int64)
        counts = np.bincount(cells, minlength=len(scores) * bins).reshape(-1, bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, at = np.nonzero((counts > 0) & (above < k))
        for column, values in zip(columns, (rid[rows][row], at, counts[row, at])):
            column.append(values)
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("rid", "bin", "n"), joined)})


def _select(k: int, norm: float, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Candidates at or above each query's k-th value: at most k of a tile, the highest, of equal ones the smallest ids."""
    rid, low = left["rid"].to_numpy(), left["low"].to_numpy()
    ids, null = right["vec_id"].fill_null(0).to_numpy(), right["vec_id"].is_null().to_numpy()
    columns: list[list] = [[], [], [], []]
    for rows, scores, there in _tiles(left, right, norm):
        row, at = np.nonzero(there & (scores >= low[rows, None]))
        order = np.lexsort((ids[at], null[at], -scores[row, at], row))
        row, at = row[order], at[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        row, at = row[kept], at[kept]
        for column, values in zip(columns, (rid[rows][row], ids[at], null[at], scores[row, at])):
            column.append(values)
    rids, ids, null, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    return pa.table({"rid": pa.array(rids, pa.int64()), "vec_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "score": pa.array(score, pa.int64())})


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as an integer; null for a null vector or one with a null or non-finite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def top_k(
    vectors: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", bins: int = BINS,
    queries: int = QUERIES, candidates: int = CANDIDATES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each row where ``asks`` is true.

    ``vector`` is an array of integers. All other rows of the table are candidates, ties go to the smaller vec_id (null last).

    1. Rows are dealt to blocks by hash; a tile is one block of queries and one of candidates, scored as a matrix product.
       Every tile is scored in every pass; scores are never stored.
    2. A query's range of possible scores is cut into ``bins``; tiles count their scores per bin, the counts are added up
       per query, and the bin with the k-th highest score is the next pass's range, until it is one value wide.
    3. Scores at or above that value are written, at most k a tile, and ranked per query.

    Blocks bound a task's memory; shuffles hold each candidate once per block of queries and each query once per block of
    candidates. Many equal scores, as of copies of a vector, are counted, not listed. Rows that repeat a vec_id are rows of their
    own: each is candidate and, if asked, query. Null vectors, those with null components and those of squared length 2^61 or
    more, whose scores no long holds, take no part. Vectors of unequal length are filled up with zeros. A query with
    fewer than k candidates gets all of them; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("vector"), asks.alias("ask"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("square", square).where(F.col("square") < 2.0**61)  # null where a component is
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    facts = rows.agg(F.count_if("ask").alias("asked"), F.count(F.lit(1)).alias("n"), F.max("square").alias("norm"), F.max(F.size("vector")).alias("dims")).first()
    if not facts["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = max(1, TILE_CELLS // max(1, facts["dims"]))
    query_blocks, blocks = -(-facts["asked"] // min(queries, most)), -(-facts["n"] // min(candidates, most))
    norm = facts["norm"]
    bound = int(norm * 1.001) + 2
    query_rows = rows.where("ask").select("rid", "vec_id", "vector", F.pmod(F.xxhash64(F.lit(1), "rid"), F.lit(query_blocks)).alias("qb"))
    candidate_tiles = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.pmod(F.xxhash64(F.lit(2), "rid"), F.lit(blocks)).cast("int").alias("cb"),
        *[F.col(c).alias(c) for c in ("rid", "vec_id", "vector")])  # columns of their own, told from the queries' ones

    def scored(level: DataFrame, function, schema: str) -> DataFrame:
        asked = query_rows.join(level.hint("shuffle_hash"), "rid").select(
            F.col("qb").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"), "rid", "low", "vector")
        return asked.groupBy("qb", "cb").cogroup(candidate_tiles.groupBy("qb", "cb")).applyInArrow(function, schema)

    level = query_rows.select("rid", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    span = 2 * bound + 1
    while span > 1:
        width = -(-span // bins)
        counted = scored(level, partial(_histogram, k, span, width, bins, norm), "rid long, bin long, n long").groupBy("rid", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("rid").orderBy(F.col("bin").desc())
        upto = counted.withColumn("upto", F.sum("n").over(down)).join(level.hint("shuffle_hash"), "rid")
        here = upto.where(F.col("above") + F.col("upto") >= k).groupBy("rid").agg(F.max_by(F.struct("low", "bin", "n", "upto", "above"), "bin").alias("at"))
        moved = here.select("rid", (F.col("at.low") + F.col("at.bin") * width).alias("low"), (F.col("at.above") + F.col("at.upto") - F.col("at.n")).alias("above"))
        # A query with fewer than k candidates keeps its range from the lowest possible score on.
        few = level.join(moved.select("rid"), "rid", "left_anti")
        level, span = staged(moved.unionByName(few), "range"), width
    found = scored(level, partial(_select, k, norm), "rid long, vec_id long, score long")
    best = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = query_rows.select("rid", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "rid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumn("embedding", quantised(F.col("embedding")))
    return top_k(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS rid, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
