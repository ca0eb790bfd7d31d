"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint that may differ, and the blocks of the index. Of 17 flips over 6 blocks, some block has at most 2.
RADIUS = 17
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """The hash of each run of ``k`` words; none where there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def shingle_rows(df: DataFrame, words: str, k: int) -> DataFrame:
    """(p, h) for each run of ``k`` words from word p. The runs are zipped slices, hashed after they have become rows, which
    keeps a corpus-wide pass inside generated code."""
    n = F.greatest(F.size(words) - k + 1, F.lit(0))
    runs = F.arrays_zip(*[F.slice(words, F.lit(j + 1), n) for j in range(k)])
    rest = [c for c in df.columns if c != words]
    rows = df.select(*rest, F.posexplode(runs).alias("p", "x"))
    return rows.select(*rest, "p", F.xxhash64(*[F.col(f"x.`{j}`") for j in range(k)]).alias("h"))


def own_shingles(words: Column) -> Column:
    """Shingles of ``SHINGLE`` words, or the one of all words where there are fewer."""
    out = shingle_hashes(words, SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(F.size(words) == k, shingle_hashes(words, k)).otherwise(out)
    return out


def with_fingerprint(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, fp): bit b is set where more than half of the words' hashes have it; a word counts as often as it occurs."""
    each = df.select(*keys, F.explode(words).alias("w")).withColumn("h", F.xxhash64("w"))
    sums = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_w"), *[F.sum(F.getbit("h", F.lit(b))).alias(f"b{b}") for b in range(64)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n_w"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def block_value(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(most + 1) for bits in combinations(range(width), r)]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Documents that hold a passage like a benchmark item: (doc_id, item_id, start, similarity), one row a pair.

    A window of a document as long as an item can be similar only if it shares a word shingle with it, so windows are
    laid where shared shingles line them up: shingle q of an item of n words found at word p gives the window of n words
    from p - q. These windows get 64-bit SimHashes over their words. The items' fingerprints are indexed in 6 blocks with all
    values up to 2 flips away, so that equality of one block finds every fingerprint within 17 bits. Pairs within the
    radius are verified: weighted Jaccard similarity of the shingles, a shingle's weight being its number of occurrences.

    Items of fewer than five words have one shingle, of all their words. Documents and items without a word match nothing.
    ``start`` is the first word of the best window. Rows that repeat a doc_id are one document whose texts all count;
    rows with a null doc_id or item_id are compared like all others. Empty tables give an empty one; other columns are ignored.
    """
    items = staged(
        benchmark.select(F.col(item_id).alias("item_id"), plain_words(F.col(item_text)).alias("iw")).distinct().where(F.size("iw") > 0)
        .select("*", F.monotonically_increasing_id().alias("item"), F.size("iw").alias("n")).withColumn("shingles", own_shingles(F.col("iw"))),
        "items",
    )
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # five values at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("body"))
    worded = rows.select("doc_id", "version", plain_words(F.col("body")).alias("dw"))
    # Written, so that Spark knows its size when it chooses the join.
    anchors = staged(items.select(F.posexplode("shingles").alias("q", "h"), "n").distinct(), "anchors")
    hits = None
    for k in lengths:
        found = shingle_rows(worded.withColumn("size", F.size("dw")), "dw", k)
        mine = anchors.where(F.least("n", F.lit(SHINGLE)) == k)
        part = found.join(mine, "h").select("doc_id", "version", F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("size") - F.col("n"))).alias("start"), "n")
        hits = part if hits is None else hits.union(part)
    if hits is None:
        hits = worded.select("doc_id", "version", F.lit(0).alias("start"), F.lit(0).alias("n")).limit(0)
    by_doc = staged(hits.distinct().groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("at")), "windows")
    where = [rows["doc_id"].eqNullSafe(F.col("_doc")), rows["version"] == F.col("_version")]
    marked = rows.join(by_doc.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "at"), where)
    windows = staged(
        marked.dropDuplicates(["doc_id", "version"]).select("doc_id", plain_words(F.col("body")).alias("dw"), F.explode("at").alias("w"))
        .select("doc_id", F.col("w.start").alias("start"), F.slice("dw", F.col("w.start") + 1, F.col("w.n")).alias("ww"))
        .withColumn("window", F.xxhash64("doc_id", "start", F.size("ww"), "ww")), "window-words",
    )
    prints = with_fingerprint(windows.dropDuplicates(["window"]), ["window"], "ww")
    item_prints = with_fingerprint(items, ["item"], "iw")
    most = RADIUS // len(BLOCKS)
    probes = [F.struct(F.lit(i).alias("block"), block_value(F.col("fp"), *b).alias("value")) for i, b in enumerate(BLOCKS)]

    def entries(i, low, width):
        flips = F.array(*[F.lit(f).cast("long") for f in _flips(width, most)])
        return F.transform(flips, lambda f: F.struct(F.lit(i).alias("block"), block_value(F.col("fp"), low, width).bitwiseXOR(f).alias("value")))

    index = [entries(i, *b) for i, b in enumerate(BLOCKS)]
    indexed = item_prints.select("item", F.col("fp").alias("ifp"), F.explode(F.concat(*index)).alias("x")).select("item", "ifp", "x.*")
    probed = prints.select("window", "fp", F.explode(F.array(*probes)).alias("x")).select("window", "fp", "x.*")
    near = probed.join(indexed, ["block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("window", "item").distinct()
    counted = windows.dropDuplicates(["window"]).select("window", F.explode(own_shingles(F.col("ww"))).alias("h")).groupBy("window", "h").agg(F.count(F.lit(1)).alias("cw"))
    weights = items.select("item", F.explode("shingles").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("ci"))
    both = near.join(counted, "window").join(weights, ["item", "h"]).groupBy("window", "item").agg(F.sum(F.least("cw", "ci")).alias("inter"))
    sizes = windows.select("window", "doc_id", "start", F.size(own_shingles(F.col("ww"))).alias("nw"))
    scored = both.join(items.select("item", "item_id", F.size("shingles").alias("ni")), "item").join(sizes, "window")
    score = F.col("inter") / (F.col("nw") + F.col("ni") - F.col("inter"))
    good = scored.withColumn("score", score).where(F.col("score") >= similarity)
    best = F.max(F.struct("score", (-F.col("start")).alias("back")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.score").alias("similarity")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    found = contaminated(docs, table(spark, folder, "benchmark")).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_leak_id")), "left_anti")


SQL = f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS n, least(len(w), {SHINGLE}) AS k, list_transform(range(len(w) - least(len(w), {SHINGLE}) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), {SHINGLE})], ' ')) AS s FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, unnest(range(len(s))) AS q, unnest(s) AS h FROM items),
dpos AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM dw, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
dsh AS (SELECT doc_id, len(w) AS size, k, p, array_to_string(w[p + 1 : p + k], ' ') AS h FROM dpos),
wins AS (SELECT DISTINCT doc_id, greatest(0, least(p - q, size - n)) AS start, n FROM dsh JOIN ish USING (k, h)),
ww AS (SELECT doc_id, start, w[start + 1 : start + n] AS v FROM wins JOIN dw USING (doc_id)),
ws AS (SELECT doc_id, start, len(v) AS m, unnest(list_transform(range(len(v) - least(len(v), {SHINGLE}) + 1), lambda i: array_to_string(v[i + 1 : i + least(len(v), {SHINGLE})], ' '))) AS h FROM ww),
wc AS (SELECT doc_id, start, m, h, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id, start, m) AS nw FROM ws GROUP BY doc_id, start, m, h),
ic AS (SELECT item_id, h, count(*) AS c, sum(count(*)) OVER (PARTITION BY item_id) AS ni FROM ish GROUP BY item_id, h),
scored AS (SELECT doc_id, item_id, start, m, CAST(sum(least(wc.c, ic.c)) AS DOUBLE) / (any_value(nw) + any_value(ni) - sum(least(wc.c, ic.c))) AS score FROM wc JOIN ic USING (h) GROUP BY doc_id, item_id, start, m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, start) AS r FROM scored WHERE score >= {SIMILARITY})
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, score AS similarity FROM ranked WHERE r = 1
"""
