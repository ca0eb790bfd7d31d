"""Phrase collocation mining over Rabin-Karp fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

LONGEST = 4
MIN_COUNT = 30
#: A candidate goes where one that holds it has this share of its occurrences.
COVERED = 0.8
TOP = 2000
#: Bytes of text whose n-grams are counted together in a task.
CHUNK_BYTES = 1 << 23
#: Bits of the set of frequent fingerprints that a pass ships to its tasks: a bound on its size. With more fingerprints than
#: bits the set lets more rare n-grams through to the shuffle, which then drops them; results stay the same.
FILTER_BITS = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Ends of pieces become line feeds, tabs spaces, A-Z small letters.
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass
class Chunk:
    """The words of many texts in a row: a word is a number, equal for equal words."""

    word: np.ndarray
    known: pa.Array
    hashes: np.ndarray
    room: np.ndarray
    text: np.ndarray
    language: np.ndarray
    names: list[str]
    marks: np.ndarray

    def prints(self, length: int) -> np.ndarray:
        seeds = np.array([xxhash.xxh3_64_intdigest(n) for n in self.names], np.uint64)
        return fingerprints(self.hashes[self.word], seeds[self.language[self.text]], length)

    def equal(self, where: np.ndarray, lead: np.ndarray, length: int) -> np.ndarray:
        """Whether the n-grams at two places are the same words of the same language."""
        out = self.language[self.text[where]] == self.language[self.text[lead]]
        for i in range(length):
            out &= self.word[where + i] == self.word[lead + i]
        return out

    def groups(self, where: np.ndarray, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first occurrence, number of occurrences) of each n-gram among ``where``.

        Those that share a fingerprint are compared with the first of them, word by word; any that differs counts by itself.
        """
        where = where[np.argsort(prints[where], kind="stable")]
        if not len(where):
            return where, where
        new = np.r_[True, prints[where[1:]] != prints[where[:-1]]]
        same = self.equal(where, where[np.flatnonzero(new)][np.cumsum(new) - 1], length)
        counts = np.add.reduceat(same.astype(np.int64), np.flatnonzero(new))
        return np.concatenate([where[new], where[~same]]), np.concatenate([counts, np.ones((~same).sum(), np.int64)])


def _chunk(texts: list[tuple[str, bytes, int]]) -> Chunk:
    langs, folded, marks = zip(*texts)
    split_texts = pc.split_pattern(pa.array(folded, pa.large_binary()).cast(pa.large_string()), "\n")
    split = pc.ascii_split_whitespace(split_texts.values)  # only blanks are left of it
    there = pc.greater(pc.binary_length(split.values), 0)
    upto = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    ends = upto[split.offsets.to_numpy()]
    coded = split.values.filter(there).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word, sizes = coded.indices.to_numpy(), np.diff(ends)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words left in the piece
    text = np.repeat(np.arange(len(texts)), np.diff(ends[split_texts.offsets.to_numpy()]))
    names, language = np.unique(langs, return_inverse=True)
    return Chunk(word, coded.dictionary, hashes, room, text, language, names.tolist(), np.array(marks, np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts (language, text, mark) in portions of about CHUNK_BYTES; a longer text is a portion of its own."""
    texts, size = [], 0
    for batch in batches:
        for lang, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            folded = (text.as_py() or "").encode("utf-8", "replace").translate(_FOLD)
            if texts and size + len(folded) > CHUNK_BYTES:
                yield _chunk(texts)
                texts, size = [], 0
            texts.append((lang, folded, mark))
            size += len(folded)
    if texts:
        yield _chunk(texts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out)


def fingerprints(hashes: np.ndarray, seeds: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of the ``length`` words from each position on, modulo 2^64, from one prefix polynomial over all words.

    With P[i] the sum of h[j] B^j over j < i, an n-gram's polynomial is (P[i + n] - P[i]) B^-i. ``seeds`` tells languages apart.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(hashes), _BASE))])
    return _mix((prefix[length:] - prefix[:n]) * _powers(n, _INVERSE) + seeds[:n] * np.uint64(2 * length + 1))


def _allowed(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = prints >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count(lengths: tuple[int, ...], frequent: Broadcast | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, n) of the n-grams of some lengths; with ``frequent``, of those all of whose parts one word shorter than the least are in it."""
    bits, part = np.frombuffer(frequent.value, np.uint8) if frequent else None, min(lengths) - 1
    for chunk in _chunks(batches):
        inner = _allowed(chunk.prints(part), bits) if frequent else None
        for length in lengths:
            prints = chunk.prints(length)
            good = chunk.room[: len(prints)] >= length
            for i in range(length - part + 1 if frequent else 0):
                good &= inner[i : i + len(prints)]
            found, counts = np.unique(prints[good], return_counts=True)
            whole = pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["fp", "n"])
            yield from (whole.slice(i, 1 << 16) for i in range(0, len(whole), 1 << 16))


_PHRASES = "lang string, words int, phrase string, seen long, n long"


def _show(longest: int, frequent: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of the fingerprints in ``frequent``, with their occurrences and the mark of a text that holds them.

    Within a chunk an n-gram is a pointer to its first occurrence, which all others of its fingerprint are compared with;
    its words are written out once. A row of no words tells the words of each language.
    """
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("seen", pa.int64()), ("n", pa.int64())])
    bits = np.frombuffer(frequent.value, np.uint8)
    for chunk in _chunks(batches):
        words = np.bincount(chunk.language[chunk.text], minlength=len(chunk.names))
        yield pa.RecordBatch.from_pydict({"lang": chunk.names, "words": [0] * len(words), "phrase": [None] * len(words), "seen": [0] * len(words), "n": words.tolist()}, schema)
        names = pa.array(chunk.names, pa.string())
        for length in range(1, longest + 1):
            prints = chunk.prints(length)
            rows, counts = chunk.groups(np.flatnonzero((chunk.room[: len(prints)] >= length) & _allowed(prints, bits)), prints, length)
            for i in range(0, len(rows), 1 << 16):
                at = rows[i : i + (1 << 16)]
                parts = [chunk.known.take(pa.array(chunk.word[at + j])) for j in range(length)]
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(chunk.language[chunk.text[at]])), pa.array(np.full(len(at), length, np.int32)),
                    pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()),
                    pa.array(chunk.marks[chunk.text[at]]), pa.array(counts[i : i + (1 << 16)]),
                ], schema=schema)


def _bit_set(prints: DataFrame, bits: int) -> Broadcast:
    """The leading bits of all fingerprints as a set of ``bits`` bits, whatever their number."""
    at = F.shiftrightunsigned("fp", 64 - bits.bit_length() + 1)
    bytes_set = prints.select(F.shiftright(at, 3).cast("int").alias("byte"), F.expr("shiftleft(1, 0)").alias("one"), (at % 8).cast("int").alias("bit"))
    mask = F.bit_or(F.expr("shiftleft(one, bit)").cast("short")).alias("mask")
    out = np.zeros(bits // 8, np.uint8)
    for batch in bytes_set.groupBy("byte").agg(mask).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint8)
    return prints.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, filter_bits: int = FILTER_BITS
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, words, phrase, f, seen) of all phrases with ``min_count`` occurrences, and (lang, n) of all words.

    Passes over the texts count single words, pairs, and all longer phrases: tasks hash every n-gram from prefix polynomials
    and count those whose parts were frequent in the pass before, and the shuffle adds up counts by fingerprint. A last pass
    takes the n-grams with a frequent fingerprint only. Tasks keep one pointer per fingerprint, compare all its occurrences
    with the words there and write these out once, with a mark of the text (``seen``, its xxhash64); the shuffle adds up
    by words. So counts are of words, not of fingerprints: phrases that share one are told apart, and rare ones are dropped.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    frequent, heavy = None, None
    for lengths in [(1,), (2,), tuple(range(3, longest + 1))]:
        if lengths and lengths[0] <= longest:
            counted = rows.mapInArrow(partial(_count, lengths, frequent), "fp long, n long")
            found = staged(counted.groupBy("fp").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).select("fp"), f"frequent{lengths[0]}")
            frequent, heavy = _bit_set(found, filter_bits), found if heavy is None else heavy.union(found)
    shown = rows.mapInArrow(partial(_show, longest, _bit_set(heavy, filter_bits)), _PHRASES)
    phrases = shown.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"), F.min("seen").alias("seen"))
    phrases = staged(phrases.where((F.col("words") == 0) | (F.col("f") >= min_count)), "phrases")
    return phrases.where("words > 0"), phrases.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, covered: float = COVERED,
    top: int = TOP, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of highest score.

    A-Z are lower-cased, texts cut into pieces at . , ; : ! ? and line breaks, pieces into words at blanks and tabs. A
    phrase of 2 to ``longest`` words with a >= ``min_count`` occurrences is cut after its first k words into parts of l and r
    occurrences; its score is the least floor(2000000 a / (l + r)), at the smallest such k. Phrases inside a longer one
    that has ``covered`` of their occurrences are left out. ``n`` is the language's number of words.

    A null language counts as ``und``, a null or empty text has no words, repeated rows count each. Texts of any length
    are read whole; counting a chunk takes memory by its words, or by those of one text if they are more. Other columns are
    ignored. An empty table gives an empty result.
    """
    phrases, totals = frequent_phrases(docs, text, lang, longest, min_count, filter_bits)
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    split = phrases.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = split.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "part_f": name}), ["lang", side])
    whole = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r)"))
    scored = whole.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = split.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    around = inner.groupBy("lang", joined(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * round(covered * 100)))
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


SQL = f"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, {LONGEST} + 1)) AS m))),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {MIN_COUNT}),
cuts AS (
    SELECT c.lang, c.m, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST((CAST(c.f AS HUGEINT) * 2000000) // (x.f + y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
    SELECT lang, phrase, max(f) AS longer FROM (
        SELECT lang, f, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM (SELECT lang, f, w, m, size, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM f WHERE m > 2)))
    GROUP BY lang, phrase),
kept AS (SELECT w.* FROM worst w LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
