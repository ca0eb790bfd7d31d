"""Jaccard self-join of documents on word n-grams by banded MinHash, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 meets in some band with probability 1 - (1 - 0.8 ** 6) ** 24 = 0.9993; of 0.3 with 0.02.
BANDS, ROWS = 24, 6
#: Documents of a bucket are compared in blocks of about this many, a pair of blocks at a time.
BLOCK = 512
CACHE_WORDS = 300_000
_CHUNK = 1 << 16
_RANDOM = np.random.default_rng(20240)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _RANDOM.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
_KNOWN: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of all words, where there are fewer."""
    words = (text or "").encode("utf-8", "replace").split()  # bytes split at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > CACHE_WORDS:
        _KNOWN.clear()
    for w in words:
        if w not in _KNOWN:
            _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out += _mix(h[i : i + n]) * _POWERS[i]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes (documents x bands, int64) of non-empty shingle sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    mins = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        x = (low ^ _XOR[k]) * _MUL[0, k]
        x ^= x >> np.uint32(15)
        x *= _MUL[1, k]
        mins[:, k] = np.minimum.reduceat(x, starts)
    rows = mins.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        out = _mix(out * np.uint64(31) + rows[:, :, r] + np.uint64(r + 1))
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
    held: list[tuple] = []

    def flush():
        full = [s for _, s in held if len(s)]
        bands = iter(signatures(full).tolist() if full else [])
        with np.errstate(over="ignore"):
            rows = [
                (i, int(_mix(s).sum().view(np.int64)), int(_mix(s + np.uint64(7919)).sum().view(np.int64)), len(s), next(bands)) if len(s) else (i, 0, 0, 0, [])
                for i, s in held
            ]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append((i, shingle_set(t.as_py())))
            size += len(held[-1][1])
            if size > _CHUNK or len(held) >= 4096:
                yield flush()
                size = 0
    if held:
        yield flush()


_PAYLOAD = "band int, value long, low int, high int, own int, doc long, copies long, bands array<int>, buckets array<long>, shingles binary"


def _deal(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document to every pair of blocks of its buckets that has its own block."""
    schema = pa.schema([
        ("band", pa.int32()), ("value", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("own", pa.int32()), ("doc", pa.int64()), ("copies", pa.int64()),
        ("bands", pa.list_(pa.int32())), ("buckets", pa.list_(pa.int64())), ("shingles", pa.binary())])
    rows, size = [], 0
    for batch in batches:
        for doc, copies, buckets, text in zip(*[c for c in batch.columns]):
            doc, copies, buckets = doc.as_py(), copies.as_py(), buckets.as_py()
            data = shingle_set(text.as_py()).tobytes()
            bands, values = [b["band"] for b in buckets], [b["value"] for b in buckets]
            for b in buckets:
                blocks = -(-b["m"] // block)
                own = xxhash.xxh3_64_intdigest(str(doc)) % blocks
                for other in range(blocks):
                    rows.append((b["band"], b["value"], min(own, other), max(own, other), own, doc, copies, bands, values, data))
                    size += len(data) + 400
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(first) - 1
    shared = (np.bincount(column) > 1)[column]
    _, column = np.unique(column[shared], return_inverse=True)
    owner, out = owner[shared], np.zeros((n, n))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 4097, 4096)) if len(column) else []
    for low, high in zip(cuts, cuts[1:]):
        m = np.zeros((n, 4096), np.float32)
        m[owner[low:high], column[low:high] % 4096] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def links_of(entries: list[tuple], band: int, low: int, high: int, similarity: float) -> list[tuple[int, int, int]]:
    """(document, copies it is linked to, smallest document of its part) from one pair of blocks of one bucket.

    A pair that meets in several buckets counts in that of its first common band only, and one that meets in a pair of
    different blocks only there.
    """
    own, docs, copies = (np.array([e[i] for e in entries]) for i in range(3))
    sets = [np.frombuffer(e[5], np.uint64) for e in entries]
    size = np.array([len(s) for s in sets])
    ask = docs[:, None] != docs[None, :]
    if low != high:
        ask &= own[:, None] != own[None, :]
    longer = np.maximum(size[:, None], size[None, :])
    ask &= np.minimum(size[:, None], size[None, :]) >= similarity * longer - 1e-9
    earlier = np.zeros((len(entries), band), np.int64)
    there = np.zeros((len(entries), band), bool)
    for i, (_, _, _, bands, values, _) in enumerate(entries):
        for b, v in zip(bands, values):
            if b < band:
                earlier[i, b], there[i, b] = v, True
    for b in np.flatnonzero(there.sum(axis=0) > 1):
        ask &= ~((earlier[:, None, b] == earlier[None, :, b]) & there[:, None, b] & there[None, :, b])
    if not ask.any():
        return []
    both = intersections(sets)
    link = ask & (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9)
    count = link @ copies
    label = docs.copy()
    while True:
        new = np.minimum(label, np.where(link, label[None, :], label[:, None]).min(axis=1))
        if (new == label).all():
            break
        label = new
    return [(int(docs[i]), int(count[i]), int(label[i])) for i in np.flatnonzero(link.any(axis=1))]


def _verify(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("links", pa.int64()), ("part", pa.int64())])
    at, entries, out = None, [], []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], schema=schema)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:4]]
        rest = [c.to_pylist() for c in batch.columns[4:]]
        for i, key in enumerate(zip(*columns)):
            if key != at:
                if len(entries) > 1:
                    out += links_of(entries, at[0], at[2], at[3], similarity)
                at, entries = key, []
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            entries.append(tuple(c[i] for c in rest))
    if len(entries) > 1:
        out += links_of(entries, at[0], at[2], at[3], similarity)
    yield batch_of(out)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links): classes of documents joined by links of Jaccard similarity >= ``similarity``.

    1. Every document gets a 128-bit key of its shingle set and 24 band hashes of 6 MinHashes. Documents of equal sets are
       one text from here on, with its number of copies.
    2. Texts shuffle on band hashes. Of the buckets with more than one text, those with the same texts count once.
    3. Within a bucket texts are compared in pairs of blocks: about 512 texts against 512 in one task, as a matrix product
       over the shingles they share, on the full n-gram sets. A bucket of any size is many such tasks, its pairs are counted,
       not written: what leaves a task is a row per text with its number of links and its part. A pair that meets in
       several buckets is compared in the first.
    4. Parts are joined to classes by connected components.

    ``class_id`` is the smallest doc_id of the class, ``n_links`` the number of other documents, copies included, that the
    document is linked to. One row per row of ``docs``. Documents without a word link to nothing; texts of fewer than five
    words link to those with the same words. Rows that share a doc_id are one document, linked through any of its texts. A null
    doc_id belongs to no class (null) unless its text has a copy with an id. An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = staged(rows.mapInArrow(_sign, "doc_id long, k1 long, k2 long, n long, bands array<long>"), "signatures")
    key = ["k1", "k2"]
    texts = signed.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    texts = staged(texts, "texts")
    banded = texts.where("doc IS NOT NULL").select("doc", "copies", F.posexplode("bands").alias("band", "value"))
    members = [F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7919), "doc")).alias("x2")]
    buckets = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("m"), *members).where("m > 1")
    once = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "value")).alias("b")).select("b.*", "m")
    asked = banded.join(once, ["band", "value"]).groupBy("doc").agg(
        F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("band", "value", "m"))).alias("buckets"))
    asked = staged(asked, "members")
    # Candidates grow with the documents, so they meet their texts by a shuffle at every size, never by a broadcast.
    payload = rows.join(asked.hint("merge"), rows["doc_id"] == asked["doc"]).dropDuplicates(["doc", "text"]).select("doc", "copies", "buckets", "text").mapInArrow(partial(_deal, block), _PAYLOAD)
    dealt = payload.repartition("band", "value", "low", "high").sortWithinPartitions("band", "value", "low", "high")
    found = staged(dealt.mapInArrow(partial(_verify, similarity), "doc long, links long, part long"), "links")
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("doc").alias("a"), F.col("part").alias("b")))
    judged = texts.select(*key, "doc", "copies").join(links, "doc", "left").join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left")
    judged = judged.select(*key, F.coalesce("component", "doc").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.select("doc_id", *key, "n").join(judged, key, "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class, that with the smallest doc_id; rows without doc_id stay.

    Of rows that repeat a doc_id the one with the smallest text stays (then by the other columns) and the others go, also
    where their texts differ, as later stages take a doc_id for one document.
    """
    first = near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias("_first_id")).distinct()
    kept = docs.join(first, docs["doc_id"] == first["_first_id"], "left_semi")
    kept = kept.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_row"))
    kept = kept.select(*["doc_id" if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns])
    return kept.union(docs.where(F.col("doc_id").isNull()))
