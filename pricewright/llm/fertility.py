"""Quality rules from tokenizer fertility: how well public vocabularies cover a text."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Per script: fewest and most characters a token, largest share of byte-fallback pieces, least token entropy in bits. Outer
#: bounds, set around measured passages in some 25 languages; ``judge`` draws tighter ones from the documents themselves.
#: Byte-level merges hardly cover scripts other than Latin, so their texts have few characters a token by nature.
BANDS = {
    "Latin": (1.7, 8.0, 0.10, 3.0), "Latin some accents": (1.4, 8.0, 0.10, 3.0), "Latin many accents": (0.6, 8.0, 0.10, 3.0),
    "Cyrillic": (0.57, 2.0, 0.10, 3.0), "Greek": (0.6, 2.0, 0.10, 3.0), "Arabic": (0.55, 2.0, 0.15, 3.0), "Hebrew": (0.55, 2.0, 0.10, 3.0),
    "Devanagari": (0.35, 1.5, 0.35, 3.0), "Thai": (0.4, 1.5, 0.25, 3.0), "East Asian": (0.28, 2.0, 0.50, 3.0),
    "other": (0.2, 12.0, 0.50, 3.0), "other ETHIOPIC": (0.2, 2.0, 0.90, 3.0),
}
#: Of unlisted scripts the documents' own spread replaces the bands above, up to this share: beyond it no vocabulary covers the text.
MOST_FALLBACK = 0.95
#: Documents of a script at which their own spread weighs as much as the outer bounds; with more it weighs more.
EVEN_DOCS = 20
_SCRIPTS = {
    "Cyrillic": "Ѐ-ԯ", "Greek": "Ͱ-Ͽἀ-῿", "Arabic": "؀-ۿݐ-ݿ", "Hebrew": "֐-׿",
    "Devanagari": "ऀ-ॿ", "Thai": "฀-๿", "East Asian": "぀-ヿ㐀-鿿가-힯",
}
_SCRIPT_RE = {name: re.compile(f"[{chars}]") for name, chars in _SCRIPTS.items()}
_BEYOND = re.compile("[Ͱ-￿\U00010000-\U0010ffff]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_ACCENTED = re.compile("[À-ɏḀ-ỿ]")
_EAST_ASIAN = {"Kana": re.compile("[぀-ヿ]"), "Hangul": re.compile("[가-힯]")}
#: No text of a vocabulary of 50,000 tokens has more bits a token.
MOST_ENTROPY = 16.0
WINDOW = 8
#: Distinct words that a Python worker remembers (about 300 bytes each).
CACHE_WORDS = 500_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, chars_per_token double, fallback_share double, token_entropy double"
)

_MEASURED = SCHEMA.replace("kept boolean, ", "") + ", part string, magnitude int, least double, most double, share double, floor double"


class Vocabulary:
    """Token ids (byte-level merges) and piece counts (pieces with byte fallback) of words, each looked at once."""

    def __init__(self, ranks: str, pieces: str):
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.counts = np.zeros((0, 2), np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.index]
        text = [w.decode("utf-8", "replace") for w in new]
        encode, rows = self.tokens.encode_ordinary, []
        for low in range(0, len(text), 20_000):
            for pieces in self.pieces.encode(text[low : low + 20_000], num_threads=1):
                rows.append((len(pieces), int(self.is_byte[pieces].sum()) if pieces else 0))
        for w, t in zip(new, text):
            self.index[w] = len(self.ids)
            self.ids.append(np.array(encode(" " + t), "<u4").tobytes())
        if rows:
            self.counts = np.concatenate([self.counts, np.array(rows, np.int64)])


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def script_of(text: str) -> str:
    if not _BEYOND.search(text):
        return "Latin" if _LATIN.search(text) else "other"
    counts = {name: len(r.findall(text)) for name, r in _SCRIPT_RE.items()} | {"Latin": len(_LATIN.findall(text))}
    most = max(counts, key=counts.__getitem__)
    return most if counts[most] else "other"


def part_of(text: str, script: str) -> str:
    """The part of a script whose texts have one spread: Latin by its accents, East Asian by its letters, others by Unicode's name."""
    if script == "Latin":
        accented = 0 if text.isascii() else len(_ACCENTED.findall(text))
        return "Latin" if 200 * accented <= len(text) else "Latin some accents" if 12 * accented <= len(text) else "Latin many accents"
    if script == "East Asian":
        found = {name: len(r.findall(text)) for name, r in _EAST_ASIAN.items()}
        most = max(found, key=found.__getitem__)
        return f"East Asian {most}" if 5 * found[most] > len(_SCRIPT_RE[script].findall(text)) else script
    if script != "other":
        return script
    names: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            names[unicodedata.name(c, "UNNAMED").split()[0]] += n
    return f"other {min(names, key=lambda k: (-names[k], k))}" if names else "other"


def repeated_words(index: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words found twice or more."""
    n = len(index) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + index[k : k + n].astype(np.uint64)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(index) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def entropy(tokens: np.ndarray) -> float:
    _, c = np.unique(tokens, return_counts=True)
    return float(np.log2(len(tokens)) - (c * np.log2(c)).sum() / len(tokens))


def measure(text: str | None, words: list[bytes], vocabulary: Vocabulary, bands: dict) -> tuple:
    """The columns of ``_MEASURED`` after doc_id."""
    text, n = text or "", len(words)
    index = np.fromiter(map(vocabulary.index.__getitem__, words), np.int64, n)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    repeats = repeated_words(index)
    failed = n < 20 or 100 * repeats > 30 * n
    script, per_token, fallback, bits, part, magnitude, bounds = "other", None, None, None, "other", None, (None,) * 4
    if n:
        tokens = np.frombuffer(b"".join([vocabulary.ids[i] for i in index.tolist()]), "<u4")
        pieces, bytes_ = vocabulary.counts[index].sum(axis=0)
        script, per_token, fallback, bits = script_of(text), chars / len(tokens), float(bytes_ / max(1, pieces)), entropy(tokens)
        part, magnitude = part_of(text, script), len(tokens).bit_length()
        bounds = bands.get(part) or bands[script]
    return (n, chars, sum(map(text.count, "#*$%&|<>")), duplicate_lines(text), repeats, failed, script, per_token, fallback, bits, part, magnitude, *bounds)


def _run(ranks: str, pieces: str, bands: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = (ranks, pieces)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(ranks, pieces)
    vocabulary = _VOCABULARIES[key]
    types = [pa.int64()] * 6 + [pa.bool_(), pa.string()] + [pa.float64()] * 3 + [pa.string(), pa.int32()] + [pa.float64()] * 4
    names = [c.split()[0] for c in _MEASURED.split(", ")]
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            ids, texts = (c.to_pylist() for c in batch.slice(low, 256).columns)
            words = [(t or "").encode("utf-8", "replace").split() for t in texts]  # bytes split at ASCII white space only
            if len(vocabulary.ids) > CACHE_WORDS:
                vocabulary.clear()
            vocabulary.learn(set().union(*words))
            rows = [(i, *measure(t, w, vocabulary, bands)) for i, t, w in zip(ids, texts, words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _spread(value: str):
    """Exact 5th, 50th and 95th percentile of thousandths, so that a group has few distinct values whatever its size."""
    return F.percentile(F.round(value, 3), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))


def _low(spread: str, margin: Column) -> Column:
    p = F.col(spread)
    return p[0] - F.greatest(1.5 * (p[1] - p[0]), margin)


def _high(spread: str, margin: Column) -> Column:
    p = F.col(spread)
    return p[2] + F.greatest(1.5 * (p[2] - p[1]), margin)


def spreads(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bands drawn from the documents that pass the base rules: of characters per token and fallback share by part of a
    script, of entropy by part and order of magnitude of the tokens, as entropy grows with a text's length. A bound lies 1.5
    times the distance from the median to the percentile beyond that percentile, and at least a small margin."""
    sound = measured.where(~F.col("base_failed"))
    parts = sound.groupBy("part").agg(F.count(F.lit(1)).alias("n"), _spread("chars_per_token").alias("c"), _spread("fallback_share").alias("f"))
    lengths = sound.groupBy("part", "magnitude").agg(F.count(F.lit(1)).alias("n"), _spread("token_entropy").alias("b"))
    small = 0.03 * F.col("c")[1]
    return (
        parts.select("part", F.col("n").alias("c_n"), _low("c", small).alias("c_low"), _high("c", small).alias("c_high"), _high("f", F.lit(0.05)).alias("f_high")),
        lengths.select("part", "magnitude", F.col("n").alias("b_n"), _low("b", F.lit(1.0)).alias("b_low"), _high("b", F.lit(1.0)).alias("b_high")),
    )


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: dict = BANDS, ranks: str = RANKS, pieces: str = PIECES,
    even_docs: int = EVEN_DOCS,
) -> DataFrame:
    """Base counts and the fertility verdict of every document; texts are read once and not shuffled.

    Characters per token and token entropy come from a byte-level vocabulary, the byte-fallback share from a piece
    vocabulary; a word's tokens are those of the word after a space. A document is kept if the base rules pass and the
    three measures lie within the bands of its most frequent script. A bound lies between that of ``bands`` and that of the
    spread of the documents themselves (``spreads``), where the spread is the tighter one or ``bands`` doesn't list the script; with n
    documents the spread has the weight n / (n + ``even_docs``), so that no single document turns the verdict of others. A spread is that of real text as long as fewer than one in twenty of a script's documents are debris.

    Returns the columns of ``SCHEMA``, one row per row. A null or empty text has no words, fails the base rules, and has
    null measures. Repeated rows give equal rows, an empty table an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = staged(rows.mapInArrow(partial(_run, ranks, pieces, bands), _MEASURED), "measures")
    parts, lengths = (F.broadcast(s) for s in spreads(measured))  # a few hundred rows at most
    unlisted = (F.col("script") == "other") & ~F.col("part").isin(*bands)

    def bound(outer: Column, spread: Column, n: str, tighter) -> Column:
        """The outer bound moved towards the spread's by the weight of n documents; outwards only for unlisted scripts."""
        moved = outer + (spread - outer) * F.col(n) / (F.col(n) + even_docs)
        return F.coalesce(F.when(unlisted, moved), tighter(outer, moved), outer)

    least, most, share, floor = (F.col(c) for c in ("least", "most", "share", "floor"))
    fine = (
        (F.col("chars_per_token") >= bound(least, F.col("c_low"), "c_n", F.greatest)) & (F.col("chars_per_token") <= bound(most, F.col("c_high"), "c_n", F.least))
        & (F.col("fallback_share") <= bound(share, F.least("f_high", F.lit(MOST_FALLBACK)), "c_n", F.least))
        & (F.col("token_entropy") >= F.greatest(floor, bound(floor, F.col("b_low"), "b_n", F.greatest)))
        & (F.col("token_entropy") <= bound(F.lit(MOST_ENTROPY), F.col("b_high"), "b_n", F.least))
    )
    out = measured.join(parts, "part", "left").join(lengths, ["part", "magnitude"], "left")
    return out.withColumn("kept", F.coalesce(~F.col("base_failed") & fine, F.lit(False))).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))
