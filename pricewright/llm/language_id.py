"""Language identification with unigram pieces, summed over all segmentations of a text."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"
UNKNOWN = "und"
#: The model is fitted on about this many labelled documents a language, chosen by a hash of their text.
TRAIN_DOCS = 8_000
#: Weight of the pooled distribution in each language's, in pieces.
SMOOTHING = 2_000.0
#: Pieces that a Python worker remembers the scores of.
CACHE_WORDS = 300_000
#: Positions after which partial sums are rescaled.
_RESCALE = 16
_BASE = np.uint64(0x100000001B3)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


class Pieces:
    """The vocabulary's pieces by hash, for looking up many substrings at once. Characters outside it share id 0."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        usable = [(i, self.model.id_to_piece(i)) for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        usable = [(i, p) for i, p in usable if p]
        self.n, self.longest = n, max(len(p) for _, p in usable)
        hashes = np.array([self.hash(p) for _, p in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for i, _ in usable])[order]

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, -1 for hashes of none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def forward(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each language: the sum over all its segmentations into pieces.

    ``probability`` has a row per piece id and a column per language. Words of one length are handled together, position by
    position; a[j] is the sum over piece lengths l of a[j - l] times the probability of the piece that ends at j.
    """
    out = np.zeros((len(words), probability.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, all_rows in by_length.items():
        step = max(1, 2_000_000 // max(1, n * probability.shape[1]))
        for low in range(0, len(all_rows), step):
            rows = all_rows[low : low + step]
            if n == 0:
                continue
            codes = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), "<u4").reshape(len(rows), n).astype(np.uint64)
            out[rows] = _forward(codes, pieces, probability)
    return out


def _forward(codes: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    m, n = codes.shape
    top = min(pieces.longest, n)
    a = np.zeros((n + 1, m, probability.shape[1]))
    a[0] = 1
    scale = np.zeros((m, probability.shape[1]))
    ends: list[np.ndarray] = []  # hashes of the substrings from each open start to the last position
    for j in range(1, n + 1):
        c = codes[:, j - 1]
        ends = [e * _BASE + c + np.uint64(1) for e in ends[-(top - 1):]] if top > 1 else []
        ends.append(c + np.uint64(1))
        for back, h in enumerate(reversed(ends)):
            ids = pieces.find(h)
            if back == 0:
                ids = np.where(ids < 0, 0, ids)  # a single character is always a piece
                a[j] += a[j - 1] * probability[ids]
            else:
                hit = ids >= 0
                if hit.any():
                    a[j][hit] += a[j - back - 1][hit] * probability[ids[hit]]
        if j % _RESCALE == 0:
            factor = a[j].copy()
            a[max(0, j - top) : j + 1] /= factor
            scale += np.log(factor)
    return np.log(a[n]) + scale


def _usable(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def _words(text: str) -> list[str]:
    return text.split()


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the vocabulary's own segmentation, counted per language within the task; a batch's words are cut once."""
    pieces, counts = pieces_of(path), {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            words.setdefault(lang, Counter()).update(_words(text or ""))
        for lang, mine in words.items():
            cut = pieces.model.encode(list(mine), num_threads=1)
            ids = np.fromiter((i for ids in cut for i in ids), np.int64)
            times = np.repeat(np.fromiter(mine.values(), np.int64, len(mine)), [len(ids) for ids in cut])
            counts[lang] = counts.get(lang, 0) + np.bincount(ids, times, pieces.n).astype(np.int64)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "piece", "n"])


class Model:
    """Languages, piece probabilities (piece id x language) and log priors; of bounded size, the vocabulary times the languages."""

    def __init__(self, languages: list[str], probability: np.ndarray, prior: np.ndarray):
        self.languages, self.probability, self.prior = languages, probability, prior


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = PIECES, train_docs: int = TRAIN_DOCS) -> Model:
    """Piece probabilities per language from labelled documents that aren't held out.

    A sample of about ``train_docs`` documents a language is taken by hash, the documented bound of the fit. Pieces are
    counted inside the tasks and summed per (language, piece). Each language's distribution is smoothed with the pooled one,
    which has every piece at least once. The priors are the languages' shares of all labelled documents.
    """
    spark = docs.sparkSession
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    pieces = pieces_of(vocabulary)
    if not languages:
        return Model([], np.ones((pieces.n, 0)), np.zeros(0))
    shares = spark.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counted = drawn.select("lang", "text").mapInArrow(partial(_count, vocabulary), "lang string, piece long, n long")
    counts = np.zeros((pieces.n, len(languages)))
    for r in counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["piece"], languages.index(r["lang"])] = r["n"]
    pooled = counts.sum(axis=1) + 1
    probability = counts + SMOOTHING * (pooled / pooled.sum())[:, None]
    probability /= probability.sum(axis=0)
    prior = np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values()))
    return Model(languages, probability, prior)


class Scorer:
    """Scores words once per Python worker."""

    def __init__(self, model: Model, path: str):
        self.model, self.pieces = model, pieces_of(path)
        self.clear()

    def clear(self) -> None:
        self.index, self.scores = {}, np.zeros((0, len(self.model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        usable = [_usable(t) for t in texts]
        words = [_words(t) if ok else [] for t, ok in zip(texts, usable)]
        if len(self.index) > CACHE_WORDS:
            self.clear()
        new = list(set().union(*words).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.scores = np.concatenate([self.scores, forward([START + w for w in new], self.pieces, self.model.probability)])
        langs, scores = [], []
        for ok, ws in zip(usable, words):
            if not ok or not self.model.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws))
            total = self.scores[at].sum(axis=0) + self.model.prior
            share = np.exp(total - total.max())
            best = int(share.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


_SCORERS: dict[str, Scorer] = {}


def _scorer(shared, path: str, name: str) -> Scorer:
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(shared.value, path)
    return _SCORERS[name]


def _predict(shared, path: str, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            langs, scores = _scorer(shared, path, name).predict(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def _keep(shared, path: str, name: str, column: int, least_score: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            langs, scores = _scorer(shared, path, name).predict(part.column(column).to_pylist())
            yield part.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in zip(langs, scores)], pa.bool_()))


def _shared(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)
    return shared, f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", vocabulary: str = PIECES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the most probable language and its posterior, one row per row.

    A text's probability is that of its white-space separated words, each summed over all its segmentations. No piece spans
    two words, so this is the sum over all segmentations of the text. Each worker scores a distinct word once.
    Only the text is looked at. A text that is null or has no letter is ``und`` with score 0, as is every text if no
    labelled document was there to learn from. A null doc_id isn't held out. Repeated rows give equal rows.
    """
    shared, name = _shared(docs.sparkSession, model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_predict, shared, vocabulary, name), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, folder: str, least_score: float = 0.5) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or no language more likely than not. One pass, no shuffle."""
    shared, name = _shared(spark, fit(docs))
    return docs.mapInArrow(partial(_keep, shared, PIECES, name, docs.columns.index("text"), least_score), docs.schema)
