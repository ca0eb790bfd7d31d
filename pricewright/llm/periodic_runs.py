"""Maximal periodic runs of words, located by block convolution at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

MIN_LENGTH = 12
#: Documents are searched together until they have this many words; a longer document is searched by itself.
CHUNK_WORDS = 1 << 17
#: Longer periods are looked for with the first so many words of a block.
LONGEST_BLOCK = 1 << 16
#: Numbers in one transform's array.
_CELLS = 1 << 18
#: Primes with 2^20 | p - 1 and a generator of each; together they tell 0 from all sums below their product.
PRIMES = ((4293918721, 19), (4276092929, 3))
_ROOTS: dict[tuple[int, int, int], list[np.ndarray]] = {}


def _twiddles(prime: int, generator: int, size: int) -> list[np.ndarray]:
    """Powers of the root of unity for each level of a transform of ``size``, largest level first."""
    if (prime, generator, size) not in _ROOTS:
        levels, n = [], size
        while n > 1:
            root, powers = pow(generator, (prime - 1) // n, prime), np.ones(n // 2, np.uint64)
            filled = 1
            while filled < n // 2:
                step = np.uint64(pow(root, filled, prime))
                powers[filled : 2 * filled] = powers[:filled] * step % np.uint64(prime)
                filled *= 2
            levels.append(powers)
            n //= 2
        _ROOTS[prime, generator, size] = levels
    return _ROOTS[prime, generator, size]


def ntt(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Number-theoretic transform of each row modulo ``prime``; the result is in bit-reversed order."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    for w in _twiddles(prime, generator, size):
        half = len(w)
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        x = np.stack([(a + b) % p, (a + (p - b)) % p * w % p], axis=2)
    return x.reshape(rows, size)


def inverse_ntt(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Inverse of ``ntt``: takes the bit-reversed order, gives the natural one."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    for w in reversed(_twiddles(prime, pow(generator, -1, prime), size)):
        half = len(w)
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1] * w % p
        x = np.stack([(a + b) % p, (a + (p - b)) % p], axis=2)
    return x.reshape(rows, size) * np.uint64(pow(size, -1, prime)) % p


def square_distances(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Sum of (block - window)^2 modulo ``prime`` at every shift of each row's block along its window.

    sum (x - y)^2 = sum x^2 - 2 sum x y + sum y^2; the middle term is one convolution with the reversed block.
    """
    p, (rows, b), shifts = np.uint64(prime), blocks.shape, windows.shape[1] - blocks.shape[1] + 1
    size = 1 << (windows.shape[1] + b - 2).bit_length()
    x, y = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
    x[:, :b], y[:, : windows.shape[1]] = blocks[:, ::-1], windows
    product = ntt(x, prime, generator) * ntt(y, prime, generator) % p
    cross = inverse_ntt(product, prime, generator)[:, b - 1 : b - 1 + shifts]
    own = (blocks * blocks % p).sum(axis=1) % p
    upto = np.zeros((rows, windows.shape[1] + 1), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=upto[:, 1:])
    other = (upto[:, b:] - upto[:, :-b]) % p
    return (own[:, None] + other + np.uint64(2) * (p - cross)) % p


def occurrences(text: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances): where the block at a start comes again unchanged, ``low`` to ``high`` words later.

    ``text`` must have ``high + block`` numbers of filling behind the last start. A sum of squared differences is zero only
    where all words are equal, and it is told from zero exactly as ``block * text.max() ** 2`` is below the primes' product.
    """
    primes = PRIMES[: 1 if block * int(text.max()) ** 2 < PRIMES[0][0] else 2]
    per_step = max(1, _CELLS // (4 * block))
    found_at, found_by = [], []
    for first in range(low, high + 1, 2 * block):
        reach = np.arange(first, min(high + 1, first + 2 * block) + block - 1)
        for i in range(0, len(starts), per_step):
            at = starts[i : i + per_step, None]
            blocks, windows = text[at + np.arange(block)], text[at + reach]
            row, shift = np.nonzero(square_distances(blocks, windows, *primes[0]) == 0)
            for prime in primes[1:]:
                if len(row):
                    asked, row_of = np.unique(row, return_inverse=True)
                    zero = square_distances(blocks[asked], windows[asked], *prime)[row_of, shift] == 0
                    row, shift = row[zero], shift[zero]
            found_at.append(starts[i : i + per_step][row])
            found_by.append(shift + first)
    return np.concatenate(found_at), np.concatenate(found_by)


def scales(min_length: int, longest: int, longest_block: int = LONGEST_BLOCK) -> Iterator[tuple[int, int, int, int]]:
    """(block, stride, smallest period, largest period): every run of such a period holds, with its next occurrence, an aligned block.

    A run of period q is ``max(min_length, 2 q)`` long at least, so it holds a block at a multiple of the stride with its
    copy q later if stride - 1 + block + q is not above that.
    """
    half = min_length // 2
    if half:
        block = 1 << max(0, ((min_length - half + 1) * 2 // 3).bit_length() - 1)
        yield min(block, longest_block), max(1, min_length - half + 1 - block), 1, half
    low = half + 1
    while low <= longest // 2:
        block = 1 << (((low + 1) // 2).bit_length() - 1)
        yield min(block, longest_block), block, low, 4 * block - 2
        low = 4 * block - 1


def _primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + ([n] if n > 1 else [])


def _extend(text: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int, width: int) -> np.ndarray:
    """How far equality at ``distance`` goes on from ``at`` in the direction of ``step``; ``width`` words a look."""
    reach, active = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(active):
        following = []
        for part in np.array_split(active, max(1, len(active) * width // _CELLS)):
            i = (at[part] + step * reach[part])[:, None] + step * np.arange(width)
            j = i + distance[part, None]
            inside = (i >= 0) & (j < len(text))
            same = inside & (text[np.where(inside, i, 0)] == text[np.where(inside, j, 0)])
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            reach[part] += run
            following.append(part[run == width])
        active = np.concatenate(following)
    return reach


def find_runs(text: np.ndarray, next_same: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal runs in the numbers ``text``, by start, then period.

    ``next_same`` is the distance to the next equal number, ``longest`` the length of the longest document in ``text``;
    no number is in two documents.

    At each scale aligned blocks are convolved with the window behind them. Blocks with a number that isn't in reach
    again can't recur and are left out, so are those whose whole window lies in a run of a period no longer than the block:
    they recur at its multiples only. Distances of neighbouring blocks that agree are one seed; a seed is extended to
    both sides, and kept if it is long enough and its period is not a multiple of a smaller one.
    """
    n, found = len(text), []
    largest = LONGEST_BLOCK
    while largest * (int(text.max()) + 1) ** 2 >= PRIMES[0][0] * PRIMES[1][0]:
        largest //= 2
    far, width = np.asarray(next_same, np.int64).copy(), 1
    for block, stride, low, high in scales(min_length, longest, largest):
        while width < block:  # far[i] = largest distance to the next equal number among the `width` numbers from i
            far[: n - width] = np.maximum(far[: n - width], far[width:])
            width *= 2
        starts = np.arange(0, max(0, n - block - low + 1), stride)
        ask = far[starts] <= high
        known = [r for r in found if r[2] <= block]
        for a, length, _ in known:
            ask[-(-a // stride) : max(0, (a + length - high - block) // stride + 1)] = False
        starts = starts[ask]
        if not len(starts):
            continue
        padded = np.concatenate([text, np.full(high + block, text.max() + 1, text.dtype)])
        at, by = occurrences(padded, starts, block, low, high)
        for a, length, q in found:
            inside = (at >= a) & (at + by <= a + length) & (by % q == 0)
            if inside.any():
                at, by = at[~inside], by[~inside]
        if not len(at):
            continue
        order = np.lexsort((at, by))
        at, by = at[order], by[order]
        first = np.r_[True, (by[1:] != by[:-1]) | (at[1:] > at[:-1] + block)]
        last = np.r_[first[1:], True]
        begin, end, by = at[first], at[last] + block, by[first]
        left, right = _extend(text, begin - 1, by, -1, block), _extend(text, end, by, 1, block)
        begin, length = begin - left, end - begin + left + right + by
        long_enough = length >= np.maximum(min_length, 2 * by)
        new = sorted(set(zip(begin[long_enough].tolist(), length[long_enough].tolist(), by[long_enough].tolist())))
        for a, size, q in new:
            if not any((text[a : a + q - q // p] == text[a + q // p : a + q]).all() for p in _primes_of(q)):
                found.append((a, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, next_same, starts): all documents' words as one row of numbers, equal for equal words of one document only."""
    out: list[int] = []
    base, starts = 0, [0]
    for doc in documents:
        ids: dict[bytes, int] = {}
        out.extend([ids.setdefault(w, base + len(ids)) for w in doc])
        base += len(ids)
        starts.append(len(out))
    text = np.array(out, np.uint64)
    next_same = np.full(len(text), np.iinfo(np.int64).max)
    order = np.argsort(text, kind="stable")
    same = text[order[1:]] == text[order[:-1]]
    next_same[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return text, next_same, np.array(starts)


def _collapsed(doc: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(doc)
    edge = np.zeros(len(doc) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([doc[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


_RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _search(min_length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
    ids: list = []
    docs: list[list[bytes]] = []

    def flush():
        text, next_same, starts = numbered(docs)
        sizes = np.diff(starts)
        found = find_runs(text, next_same, int(sizes.max()), min_length) if len(text) else []
        per_doc: list[list] = [[] for _ in docs]
        owner = np.searchsorted(starts, [r[0] for r in found], "right") - 1
        for d, (start, length, period) in zip(owner.tolist(), found):
            per_doc[d].append((start - int(starts[d]), length, period))
        columns = [
            pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in per_doc], schema.field("runs").type),
            pa.array([_collapsed(d, r).decode() for d, r in zip(docs, per_doc)], pa.string()),
        ]
        ids.clear(), docs.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc = (t.as_py() or "").encode("utf-8", "replace").split()  # bytes split at ASCII white space only
            if docs and size + len(doc) > CHUNK_WORDS:
                yield flush()
                size = 0
            ids.append(i)
            docs.append(doc)
            size += len(doc)
            if len(docs) >= 4096:
                yield flush()
                size = 0
    if docs:
        yield flush()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the maximal periodic runs of words of every text.

    A run is a stretch of words with smallest period q, ``max(min_length, 2 q)`` words long at least, that no neighbouring
    word extends. ``runs`` holds (start, length, period), words counted from 0, by start, then period. ``collapsed`` is
    the text without the words that some run holds behind its first q words, joined by one space.

    At each dyadic scale aligned blocks are convolved with the words behind them (integer number-theoretic transforms of
    squared differences, exact); distances without a mismatch seed runs, which are extended word by word. Documents share
    a task's arrays but no numbers, so no run crosses them. One row per row of ``docs``, repeated and null ids included; a
    null or empty text has no word and no run. Very long texts are searched by themselves, in memory linear in their length.
    Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_search, min_length), f"doc_id long, {_RESULT}")


def planted(docs: DataFrame) -> DataFrame:
    """Documents as the query's contract has them: a tenth repeats a part of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = words(F.col("text"))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    first = F.col("_g") % F.col("_n")
    period = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    marked = docs.select(F.col("doc_id"), F.col("text"), h.alias("_h"))
    asked = F.col("_h").isNotNull() & (F.col("_h") % 10 == 0)
    plain = marked.where(~asked).select("doc_id", "text")
    changed = marked.where(asked).select("doc_id", w.alias("_words"), g.alias("_g")).withColumn("_n", n.cast("long"))
    changed = changed.withColumn("_a", F.when(F.col("_n") > 0, first)).withColumn("_p", F.when(F.col("_n") > 0, period))
    made = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i).cast("int")))
    return plain.union(changed.select("doc_id", F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise("")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.withColumn("_best", longest)
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
