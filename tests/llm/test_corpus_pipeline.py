"""The pipeline's stages, each on its own input, against brute force; awkward rows run through all of it."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from test_python_operators import brute_join
from tokenizers import Tokenizer

from pricewright.llm import token_store
from pricewright.llm.common import staged, table

SMALL = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_stages_one_by_one(spark):
    raw = table(spark, SMALL, "documents")
    odd = spark.createDataFrame(
        [(100_000, None, "en", "src0", 0), (100_001, "", None, None, 0), (100_002, "12 34 !", "en", "src0", 1), (None, "a text that has no id at all, yet some words", "en", None, 1)],
        raw.schema)
    docs = raw.union(odd).union(raw.where("doc_id < 3"))
    seen = [docs]
    for name, function in corpus_pipeline.STAGES:
        seen.append(staged(function(spark, seen[-1], SMALL), "test"))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in df.collect()} for df in seen[:-1]]
    assert set(texts[0]) - set(texts[1]) == {100_000, 100_001, 100_002}
    classes = brute_join([(i, t) for i, t in texts[1].items() if i is not None])
    assert set(texts[2]) == {c for c, _ in classes.values()} | {None} and seen[2].count() == len(texts[2])
    items = [words(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    leaks = {i for i, t in texts[2].items() if any(f" {' '.join(x)} " in f" {' '.join(words(t))} " for x in items)}
    assert leaks and not leaks & set(texts[3])
    assert all(_similar(texts[2][i], items) for i in set(texts[2]) - set(texts[3]))
    sizes, taken = Counter(), Counter()
    for r in seen[3].collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in seen[4].collect():
        taken[r["source"]] += len((r["text"] or "").split())
    assert sum(taken.values()) <= sum(sizes.values()) and all(taken[s] <= 3 * sizes[s] for s in sizes)
    plain, at = Tokenizer.from_file(token_store.VOCABULARY), 0
    got = sorted((tuple(r) for r in seen[5].collect()), key=lambda r: r[1])
    for r, doc_id in zip(got, sorted((r["doc_id"] for r in seen[4].select("doc_id").collect()), key=lambda i: (i is not None, i or 0)), strict=True):
        ids = [*plain.encode(texts[4][doc_id], add_special_tokens=False).ids, 2]
        assert r == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def _similar(text, items):
    have = words(text)
    for item in items:
        want = Counter(tuple(item[i : i + 5]) for i in range(len(item) - 4))
        for s in range(len(have) - len(item) + 1):
            w = have[s : s + len(item)]
            mine = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            inter = sum((mine & want).values())
            if inter >= 0.8 * (sum(mine.values()) + sum(want.values()) - inter):
                return True
    return False


def test_empty_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = staged(function(spark, docs, SMALL), "test")
        assert docs.count() == 0
