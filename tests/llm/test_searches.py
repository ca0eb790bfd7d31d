"""Collocations, periodic runs and top-k search against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewright.llm import collocations, exact_topk, periodic_runs


# periodic runs

def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rng):
    kinds, n = rng.choice([1, 2, 3, 10, 100]), rng.choice([0, 5, 12, 30, 100, 300])
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 4 else 0):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 2))
        for i in range(a + p, min(n, a + p + rng.randrange(1, 4 * p))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("longest_block", [1 << 16, 4])
def test_runs_of_random_words(monkeypatch, longest_block):
    monkeypatch.setattr(periodic_runs, "LONGEST_BLOCK", longest_block)
    rng = random.Random(longest_block)
    for _ in range(80):
        docs, least = [_words(rng) for _ in range(rng.randrange(1, 5))], rng.choice([2, 3, 5, 8, 12, 12, 20])
        text, next_same, starts = periodic_runs.numbered(docs)
        got = periodic_runs.find_runs(text, next_same, max(map(len, docs)), least) if len(text) else []
        want = [(int(s) + a, length, q) for d, s in zip(docs, starts) for a, length, q in brute_runs(d, least)]
        assert sorted(got) == sorted(want)


def test_words_with_many_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    text, next_same, _ = periodic_runs.numbered([b])
    assert periodic_runs.find_runs(text, next_same, len(b)) == brute_runs(b)


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    blocks, windows = rng.integers(0, 1 << 31, (3, 8)).astype(np.uint64), rng.integers(0, 1 << 31, (3, 23)).astype(np.uint64)
    windows[1, 5:13] = blocks[1]
    for prime, generator in periodic_runs.PRIMES:
        got = periodic_runs.square_distances(blocks, windows, prime, generator)
        for r in range(3):
            for s in range(16):
                assert got[r, s] == sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[r], windows[r, s : s + 8])) % prime
        assert got[1, 5] == 0


def brute_query(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_periodic_query(spark, corpus, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(x.decode() for x in _words(rng)) for _ in range(150)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (202, " \t\n", None, None), (None, "x y " * 20, None, None), (3, texts[3], None, None), (3, "z " * 30, None, None),
             (204, "ä b\x0bc ä b c\r" * 9, None, None), (205, "long " * 40_000, None, None)]
    corpus(rows).write.parquet(f"{tmp_path}/documents.parquet")
    small = [r for r in rows if r[0] != 205]
    got = periodic_runs.query(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got if r["doc_id"] != 205), key=repr) == sorted((brute_query(r[0], r[1]) for r in small), key=repr)
    long = next(r for r in got if r["doc_id"] == 205)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 40_000, 1)
    assert periodic_runs.periodic_runs(corpus(rows).limit(0)).count() == 0


# collocations

def brute_collocations(rows, least=30, top=2000, longest=4):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][w[i : i + m]] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in candidates.items())
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            if not inside:
                score, _, left, right = min(cuts)
                found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, totals[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def _prose(rng):
    pool = ["New", "york", "of", "the", "city", "ÄB", "äb", " x", "a-b", "it's"]
    out = []
    for _ in range(rng.randint(0, 40)):
        out.append(rng.choice(["new York city", "of the", rng.choice(pool), rng.choice(pool)]))
        out.append(rng.choice([" ", " ", " ", "  \t", ", ", "\n", "\x0b", ".", "!?"]))
    return "".join(out)


def test_collocations(spark, corpus):
    rng = random.Random(7)
    rows = [(i, _prose(rng), rng.choice(["en", "de", None, "und"]), "s") for i in range(200)]
    rows += [(300, None, "en", None), (301, "", "fr", None), (302, "...", "fr", None), (7, rows[7][1], rows[7][2], None), (303, "very long " * 30_000, "en", None), (None, "of the " * 50, "xx", None)]
    docs = corpus(rows)
    for least, top in ((30, 2000), (3, 5)):
        want = brute_collocations([(r[2], r[1]) for r in rows], least, top)
        got = collocations.collocations(docs.repartition(5), min_count=least, top=top)
        assert sorted(map(tuple, got.collect())) == want and want
    few_bits = collocations.collocations(docs, min_count=3, filter_bits=64)
    assert sorted(map(tuple, few_bits.collect())) == brute_collocations([(r[2], r[1]) for r in rows], 3)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_equal_fingerprints_are_told_apart(monkeypatch):
    class All:
        value = bytes([255] * 8)

    monkeypatch.setattr(collocations, "fingerprints", lambda hashes, seeds, length: np.zeros(max(0, len(hashes) - length + 1), np.uint64))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": ["a b a b c", "a b"], "mark": [1, 2]})
    phrases = Counter()
    for out in collocations._show(2, All, iter([batch])):
        for r in out.to_pylist():
            phrases[r["lang"], r["phrase"]] += r["n"]
            assert r["phrase"] is None or r["seen"] == {"en": 1, "de": 2}[r["lang"]]
    assert phrases == {("en", "a"): 2, ("en", "b"): 2, ("en", "c"): 1, ("de", "a"): 1, ("de", "b"): 1, ("en", "a b"): 2, ("en", "b a"): 1,
                       ("en", "b c"): 1, ("de", "a b"): 1, ("en", None): 5, ("de", None): 2}


def test_prefix_polynomials():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    hashes[30:34] = hashes[4:8]
    seeds = np.full(50, 9, np.uint64)
    base = int(collocations._BASE)
    for m in range(1, 5):
        got = collocations.fingerprints(hashes, seeds, m)
        plain = [sum(int(h) * base**j for j, h in enumerate(hashes[i : i + m])) for i in range(51 - m)]
        want = collocations._mix(np.array([(x + 9 * (2 * m + 1)) % (1 << 64) for x in plain], np.uint64))
        assert (got == want).all() and got[4] == got[30]
    assert len(collocations.fingerprints(hashes[:2], seeds[:2], 3)) == 0


# top-k

def brute_top(rows, every=50, k=5):
    good = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((vec_id, [math.floor(256 * x) for x in v]))
    out = []
    for i, (vec_id, v) in enumerate(good):
        if vec_id is not None and vec_id % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), other is None, other or 0) for j, (other, w) in enumerate(good) if i != j]
            out += [(vec_id, rank, None if null else other, -score) for rank, (score, null, other) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def _top(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rid int, qb string")
    asks = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    return sorted(map(tuple, exact_topk.top_k(df.withColumn("embedding", exact_topk.quantised(F.col("embedding"))), asks, **options).collect()), key=repr)


def test_top_k(spark):
    rng = random.Random(11)
    vector = lambda scale=1.0: [rng.uniform(-scale, scale) for _ in range(6)]
    rows = [(i, vector()) for i in range(300)]
    hot = vector()
    rows += [(i, hot) for i in range(300, 450)]  # a third of all rows
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, []), (750, [0.5, -0.5]), (50, rows[50][1]), (50, vector()), (None, hot), (None, None)]
    want = brute_top(rows)
    assert _top(spark, rows) == want
    assert _top(spark, rows, queries=3, candidates=40, bins=4) == want
    assert _top(spark, rows, k=600) == brute_top(rows, k=600)
    assert _top(spark, rows[:3]) == brute_top(rows[:3]) and _top(spark, rows[1:3]) == [] and _top(spark, []) == [] and _top(spark, rows[:1]) == []


@pytest.mark.parametrize("scale", [100.0, 1e4, 1e6])
def test_top_k_of_large_numbers(spark, scale):
    rng = random.Random(12)
    rows = [(i, [float(rng.randint(0, 3)) * scale, rng.uniform(-scale, scale)]) for i in range(120)]
    assert _top(spark, rows) == brute_top(rows)
    assert _top(spark, rows + [(1000, [1e300, 1.0])]) == brute_top(rows)  # its scores are no longs
