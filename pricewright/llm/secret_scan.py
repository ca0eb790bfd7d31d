"""Secret scan: patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: The model is fitted on lines of about this many documents: those with a base span, and one of each other document.
TRAIN_DOCS = 20_000
#: Lines the model is fitted on at most; with more, a share of them is drawn by hash.
TRAIN_LINES = 30_000
#: Longest piece of a line used for fitting; a span that goes on behind the cut is one up to it.
TRAIN_CHARS = 1_000
EPOCHS, RATE, BATCH = 8, 0.2, 256
#: Tagged spans shorter than this are no secrets.
LEAST_CHARS = 12
OUT, BEGIN, INSIDE = 0, 1, 2
_HASHED = 4096
_SHAPES = 8000
#: Feature blocks: own shape, own word, word before, two and three before, word after, shape before, shape after, file.
_BLOCKS = (_SHAPES, _HASHED, _HASHED, _HASHED, _HASHED, _HASHED, _SHAPES, _SHAPES, 16)
_OFFSETS = np.cumsum((0, *_BLOCKS))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHARS_AT_ONCE = 1 << 20


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the patterns' matches, leftmost and non-overlapping per kind.

    A match that is too short is dropped and still consumes its text. Runs of hex digits, and of an access key's characters,
    are matched whole, so that asking for their length in the pattern is the same.
    """
    out, lower = [], text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _classes() -> np.ndarray:
    """0 space, 1 a-f, 2 other lower case, 3 upper case, 4 digit, 5 joining sign, 6 other ASCII sign; 7 all else."""
    out = np.full(128, 6, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[97:103] = 1
    out[[ord(c) for c in "+/_-"]] = 5
    return out


_CLASS = _classes()


class Tokens:
    """Tokens of many texts and the indices of their features: runs of letters, digits and +/_-, and single other signs."""

    def __init__(self, texts: list[str], signs: list[float] | None = None):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(codes)
        self.text_at = np.cumsum([0] + [len(t) for t in texts])
        cls = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 7).astype(np.uint8)
        word = (cls != 0) & (cls != 6)
        edge = np.zeros(n + 1, bool)
        edge[self.text_at] = True
        before = np.r_[False, word[:-1]] & ~edge[:-1]
        after = np.r_[word[1:], False] & ~edge[1:]
        self.starts = np.flatnonzero((cls == 6) | (word & ~before))
        self.ends = np.flatnonzero((cls == 6) | (word & ~after)) + 1
        self.doc = np.searchsorted(self.text_at, self.starts, "right") - 1

        def summed(flags):
            c = np.zeros(n + 1, np.int32)
            np.cumsum(flags, out=c[1:])
            return c[self.ends] - c[self.starts]

        size = self.ends - self.starts
        digit, upper, low_hex = summed(cls == 4), summed(cls == 3), summed(cls == 1)
        letter = (cls == 1) | (cls == 2) | (cls == 3) | (cls == 7)
        turns = word.copy()
        turns[1:] &= word[:-1] & (letter[1:] != letter[:-1])
        turns[:1] = False
        changes = summed(turns)
        length = np.searchsorted([2, 4, 8, 12, 16, 20, 24, 32, 64], size, "right")
        digits = np.where(digit == 0, 0, np.where(digit * 5 < size, 1, np.where(digit * 5 < size * 3, 2, np.where(digit < size, 3, 4))))
        uppers = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper < size - digit, 2, 3)))
        change = np.minimum(3, np.searchsorted([1, 3, 6], changes, "right"))
        hexes = (digit + low_hex == size).astype(np.int64)
        shape = (((length * 5 + digits) * 4 + uppers) * 4 + change) * 2 + hexes
        sign = cls[self.starts] == 6
        shape = np.where(sign, 2000 + codes[self.starts] % 128, shape).astype(np.int64)
        low = np.where(cls == 3, codes + 32, codes).astype(np.uint64) + np.uint64(1)
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE)]) if n else np.ones(1, np.uint64)
        inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _INVERSE)]) if n else np.ones(1, np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(low * powers[:n], dtype=np.uint64)]
        name = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        name = ((name ^ (name >> np.uint64(31))) * _BASE >> np.uint64(52)).astype(np.int64)
        m = len(shape)
        new_doc = np.r_[True, self.doc[1:] != self.doc[:-1]] if m else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new_doc, np.arange(m), 0)) if m else np.zeros(0, np.int64)

        def shifted(values, k):
            """The value k tokens before (after, if negative) in the same text; else 0."""
            at = np.arange(m) - k
            ok = (at >= first) if k > 0 else (at < m)
            at = np.clip(at, 0, max(0, m - 1))
            if k < 0:
                ok &= self.doc[at] == self.doc
            return np.where(ok, values[at], 0) if m else values

        if signs is None:
            signs = [sign_share(t) for t in texts]
        self.signs = np.asarray(signs)
        file = np.minimum(15, (self.signs * 100).astype(np.int64))[self.doc] if m else np.zeros(0, np.int64)
        columns = (shape, name, shifted(name, 1), shifted(name, 2), shifted(name, 3), shifted(name, -1), shifted(shape, 1), shifted(shape, -1), file)
        self.features = [c + o for c, o in zip(columns, _OFFSETS)]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.starts), 3), np.float32)
        for f in self.features:
            out += weights[f]
        return out


def sign_share(text: str) -> float:
    """Share of the signs of code and configuration files in a text: a feature of the file, not of the token."""
    return sum(map(text.count, "={};\"'")) / max(1, len(text))


class Crf:
    """Weights of the features per tag, and of the transitions; a text begins after an outside tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights.astype(np.float32), moves

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Best tags by Viterbi. A token that is outside by more than all its transitions could make up for is outside on
        every best path; it is fixed first, and the stretches between fixed tokens are decoded together by length."""
        e, t = tokens.emissions(self.weights), self.moves
        tags = np.zeros(len(e), np.int8)
        gain = max(t[a, y] - t[a, OUT] + max(0.0, max(t[y, b] - t[OUT, b] for b in range(3))) for a in range(3) for y in (BEGIN, INSIDE))
        open_ = np.flatnonzero(e[:, OUT] - e[:, 1:].max(axis=1) <= gain + 1e-3)
        if not len(open_):
            return tags
        cut = np.r_[True, (np.diff(open_) > 1) | (tokens.doc[open_[1:]] != tokens.doc[open_[:-1]])]
        starts = open_[cut]
        sizes = np.diff(np.r_[np.flatnonzero(cut), len(open_)])
        for size in np.unique(sizes):
            at = starts[sizes == size]
            score, back = t[OUT][None, :] + e[at], []
            for k in range(1, size):
                ways = score[:, :, None] + t[None]
                back.append(ways.argmax(axis=1))
                score = ways.max(axis=1) + e[at + k]
            last = at + size - 1
            follows = (last + 1 < len(e)) & (tokens.doc[np.minimum(last + 1, len(e) - 1)] == tokens.doc[last])
            tag = (score + np.where(follows[:, None], t[:, OUT][None, :], 0)).argmax(axis=1)
            tags[last] = tag
            for k in range(size - 2, -1, -1):
                tag = back[k][np.arange(len(at)), tag]
                tags[at + k] = tag
        return tags

    def spans(self, tokens: Tokens, tags: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per text, the stretches of secret tokens without white space between."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(tokens.text_at) - 1)]
        for i in np.flatnonzero(tags):
            d = int(tokens.doc[i])
            start, end = (int(x - tokens.text_at[d]) for x in (tokens.starts[i], tokens.ends[i]))
            if out[d] and tags[i] == INSIDE and out[d][-1][1] == start:
                out[d][-1] = (out[d][-1][0], end)
            else:
                out[d].append((start, end))
        return [[s for s in d if s[1] - s[0] >= LEAST_CHARS] for d in out]


def gold_tags(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    tags = np.zeros(len(tokens.starts), np.int8)
    for d, mine in enumerate(spans):
        low = tokens.text_at[d]
        for s, e in mine:
            inside = np.flatnonzero((tokens.starts < low + e) & (tokens.ends > low + s))
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    return tags


def train(texts: list[str], spans: list[list[tuple[int, int]]], signs: list[float]) -> Crf:
    """Maximum likelihood by stochastic gradient steps (Adagrad), sequences of like length together."""
    weights, moves = np.zeros((_OFFSETS[-1], 3)), np.zeros((3, 3))
    weight_sq, moves_sq = np.full(weights.shape, 1e-2), np.full((3, 3), 1e-2)
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    made = []
    for g in groups:
        tokens = Tokens([texts[i] for i in g], [signs[i] for i in g])
        made.append((tokens, gold_tags(tokens, [spans[i] for i in g]), len(g)))
    shuffle = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in shuffle.permutation(len(made)):
            tokens, gold, m = made[k]
            if not len(gold):
                continue
            e = sum(weights[f] for f in tokens.features)
            sizes = np.bincount(tokens.doc, minlength=m)
            longest, first = sizes.max(), np.cumsum(sizes) - sizes
            at = np.minimum(first[:, None] + np.arange(longest), len(e) - 1)
            live = np.arange(longest) < sizes[:, None]
            energy, tags = np.where(live[..., None], e[at], 0), np.where(live, gold[at], OUT)
            alpha, beta = np.zeros(energy.shape), np.zeros(energy.shape)
            alpha[:, 0] = moves[OUT] + energy[:, 0]
            for j in range(1, longest):
                alpha[:, j] = np.where(live[:, j, None], _log_sum(alpha[:, j - 1, :, None] + moves, 1) + energy[:, j], alpha[:, j - 1])
            for j in range(longest - 2, -1, -1):
                beta[:, j] = np.where(live[:, j + 1, None], _log_sum(moves + (energy[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
            total = _log_sum(alpha[:, -1], 1)
            expected = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
            seen = np.eye(3)[tags] * live[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + moves + (energy + beta)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
            grad_moves = np.einsum("ija,ijb->ab", seen[:, :-1] * live[:, 1:, None], seen[:, 1:]) - pair.sum(axis=(0, 1))
            grad_moves[OUT] += (seen[:, 0] - expected[:, 0]).sum(axis=0)
            delta = np.zeros(e.shape)
            delta[at[live]] = (seen - expected)[live]
            moves_sq += grad_moves**2
            moves += RATE * grad_moves / np.sqrt(moves_sq)
            for f in tokens.features:
                rows, inverse = np.unique(f, return_inverse=True)
                grad = np.stack([np.bincount(inverse, delta[:, y], len(rows)) for y in range(3)], axis=1)
                weight_sq[rows] += grad**2
                weights[rows] += RATE * grad / np.sqrt(weight_sq[rows])
    return Crf(weights, moves)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("line", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("signs", pa.float64())])
    for batch in batches:
        rows = []
        for text in batch.column(0):
            text = text.as_py() or ""
            lines, at, share = text.split("\n"), 0, sign_share(text)
            spans, next_span = sorted({(s, e) for _, _, e, s in base_spans(text)}), 0  # no span crosses a line
            chosen = -1 if spans else len(text) % len(lines)
            for i, line in enumerate(lines):
                mine = []
                while next_span < len(spans) and spans[next_span][0] < at + len(line):
                    mine.append((spans[next_span][0] - at, spans[next_span][1] - at))
                    next_span += 1
                if mine or i == chosen:
                    low = max(0, mine[0][0] - TRAIN_CHARS // 2) if mine else 0
                    inside = [(s - low, min(e - low, TRAIN_CHARS)) for s, e in mine if s - low < TRAIN_CHARS]
                    rows.append((line[low : low + TRAIN_CHARS], [s for s, _ in inside], [e for _, e in inside], share))
                at += len(line) + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)


def fit(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Crf | None:
    """A field learned from the base patterns' own spans on a bounded sample; None where the sample has none.

    About ``train_docs`` documents are drawn by hash, and of their lines, which may be many in a long document, ``train_lines``
    at most about: that bounds what the driver gets and trains on.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    total = rows.count()
    share = min(1.0, train_docs / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    found = staged(drawn.mapInArrow(_examples, "line string, starts array<int>, ends array<int>, signs double").distinct(), "lines")
    portion = min(1.0, train_lines / max(1, found.count()))
    found = found.where(F.pmod(F.xxhash64("line", "starts", "signs"), F.lit(1 << 20)) < portion * (1 << 20))
    lines = sorted((r["line"], tuple(r["starts"]), tuple(r["ends"]), r["signs"]) for r in found.toLocalIterator())
    if not any(s for _, s, _, _ in lines):
        return None
    return train([x[0] for x in lines], [list(zip(x[1], x[2])) for x in lines], [x[3] for x in lines])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def uncovered(found: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The found spans that ``spans`` together don't cover."""
    merged: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]
    out = []
    for s, e in found:
        i = bisect_right(starts, s) - 1
        if i < 0 or merged[i][1] < e:
            out.append((s, e))
    return out


def _scan(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    crf = shared.value
    types = [pa.int64()] * 4 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scanned(ids, texts):
        base = [base_spans(t) for t in texts]
        tagged = [[] for _ in texts]
        if crf is not None:
            tokens = Tokens(texts)
            tagged = crf.spans(tokens, crf.decode(tokens))
        rows = []
        for i, mine, more in zip(ids, base, tagged):
            spans = [x[:3] for x in mine]
            added = [("crf", s, e) for s, e in uncovered(more, spans)]
            counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS[:3]]
            rows.append((i, *counts, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + added)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(*batch.columns):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size > _CHARS_AT_ONCE:
                yield scanned(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield scanned(ids, texts)


def scan(docs: DataFrame, crf: Crf | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``SCHEMA``, one row per row: counts and digest of the pattern matches, and all spans.

    The field reads whole texts as sequences of tokens and adds spans of kind ``crf`` unless the patterns' matches cover them, so
    that a secret of which a pattern sees a part only is there as a whole, too. Spans are kind:start:end in code points, end exclusive, by start, then kind. A null or empty text has none; repeated rows give equal
    rows, an empty table an empty one; other columns are ignored. Without a field (``crf`` None) only the patterns count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # a fixed number of weights
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_scan, shared), SCHEMA)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scan(docs, fit(docs))
