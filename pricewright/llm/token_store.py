"""Token ids in binary shards, with a minimal perfect hash index from document keys to records."""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shared_folder, staged, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: The key that a null doc_id is stored under; it sorts first, as nulls do.
NULL_KEY = -(1 << 63)
KEYS_PER_SEGMENT = 50_000
#: Pieces of text that a Python worker remembers the ids of (about 150 bytes each).
CACHE_PIECES = 1_000_000
TEXTS_AT_ONCE = 256
_GAP = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of whole texts as bytes.

    The vocabulary's own splitting rule never joins what lies before and after a single space between two visible
    characters, so a text is cut at its spaces (a space goes with what follows), each distinct piece is encoded once by the
    tokenizers library, and the pieces' ids are joined. Where a piece is empty or has white space at an end, the cut there
    would not be such a place: the text is then cut by ``_GAP`` at those that are.

    With ``added`` the vocabulary's added tokens, such as '<|endoftext|>', are one id where a text spells them out, as the
    library has it; such a text is encoded whole. Without, they are text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        spelled = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.holds_added = re.compile("|".join(map(re.escape, spelled))).search if spelled else lambda text: None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes | None] = {}
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        # Byte-level vocabularies write a space as U+0120.
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), 10_000):
            done = self.tokenizer.encode_batch_fast(pieces[i : i + 10_000], add_special_tokens=False)
            for d in done:
                ids = array(self.code, d.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                out.append(ids.tobytes())
        return out

    def _ids_of_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word after a space. Many words go through the library as one text; as no word holds a space, a
        word's ids begin where a token does that begins with one."""
        for i in range(0, len(words), 2_000):
            text = " " + " ".join(words[i : i + 2_000])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            data, at = ids.tobytes(), (np.flatnonzero(self.spaced[ids]) * self.dtype.itemsize).tolist()
            for low, high in zip(at, [*at[1:], len(data)]):
                yield data[low:high]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if self.holds_added(t)}
        if whole:
            rest = iter(self._encode_cut([t for i, t in enumerate(texts) if i not in whole]))
            apart = iter(self._ids([texts[i] for i in sorted(whole)]))
            return [next(apart if i in whole else rest) for i in range(len(texts))]
        return self._encode_cut(texts)

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, cut = self.known, [t.split(" ") for t in texts]
        firsts = [pieces.pop(0) for pieces in cut]
        new = list(set().union(*cut).difference(known))
        clean = [p for p in new if p and not (p[0].isspace() or p[-1].isspace())]
        known.update(dict.fromkeys(new))
        known.update(zip(clean, self._ids_of_words(clean), strict=True))
        get, out, rest = known.__getitem__, self._ids(firsts), []
        for i, (first, pieces) in enumerate(zip(firsts, cut)):
            try:
                if pieces and (not first or first[-1].isspace()):
                    raise TypeError
                out[i] += b"".join(map(get, pieces))
            except TypeError:  # a piece without ids
                rest.append(i)
        for i in rest:
            first, *more = _GAP.split(texts[i])
            out[i] = b"".join(self._ids([first, *[" " + m for m in more]]))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added)
    return _ENCODERS[path, added]


# Files. A shard is its payload, the ids one after the other, then for each record its key and number of ids (int64 each),
# then the number of records, the bytes of an id and the mark. Files appear under their final name only when complete.

MARK = b"TOKS"
_TAIL = struct.Struct("<qi4s")


def _place(folder: str):
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


class _NewFile:
    def __init__(self, folder: str, name: str):
        self.fs, root = _place(folder)
        self.fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{name}-{task.taskAttemptId() if task else 0}"
        self.out = self.fs.open_output_stream(self.temporary)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)


def _write_shards(folder: str, vocabulary: str, end_id: int, added: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, enc, file, keys, counts = TaskContext.get().partitionId(), encoder(vocabulary, added), None, [], []
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(low, TEXTS_AT_ONCE)
            file = file or _NewFile(folder, f"shard-{shard:06d}.bin")
            for key, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                file.out.write(ids + end)
                keys.append(key)
                counts.append(len(ids) // enc.dtype.itemsize + 1)
    if file is None:
        return
    k, n = np.array(keys, "<i8"), np.array(counts, "<i8")
    file.out.write(k.tobytes() + n.tobytes() + _TAIL.pack(len(k), enc.dtype.itemsize, MARK))
    file.close()
    at = np.cumsum(n) - n
    for low in range(0, len(k), 10_000):
        s = slice(low, low + 10_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k[s]), pa.array(np.full(len(k[s]), shard)), pa.array(np.arange(len(k))[s]), pa.array(at[s]), pa.array(n[s])],
            names=["key", "shard", "record", "first", "n_tokens"])


class Shard:
    """A shard file: keys and numbers of ids of its records, and the ids of any of them."""

    def __init__(self, folder: str, number: int):
        fs, root = _place(folder)
        self.file = fs.open_input_file(f"{root}/shard-{number:06d}.bin")
        size = self.file.size()
        n, width, mark = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if mark != MARK:
            raise ValueError(f"shard {number} is no token file")
        self.dtype = np.dtype(f"<u{width}")
        both = np.frombuffer(self.file.read_at(16 * n, size - _TAIL.size - 16 * n), "<i8")
        self.keys, self.counts = both[:n], both[n:]
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, record: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(int(self.counts[record]) * width, int(self.starts[record]) * width), self.dtype)


# The index. Keys are dealt by hash into segments of bounded size. A segment's function is a cascade of bit arrays: a key
# that is alone on its bit at a level ends there, the others go to the next level; its slot is the number of set bits
# before its own. Each slot stores a fingerprint of its key, where its first record is, and how many shards its records go over.

_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("shards", "<u4")])


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 999) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys onto 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bases = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = (_mixed(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't in the set, some slot or -1."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for i, (alone, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = (_mixed(keys[open_], i + 1) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[open_[hit]] = self.bases[i] + rank[at[hit]]
            open_ = open_[~hit]
        return out


class Segment:
    """A segment of the index: the perfect hash and the slots."""

    def __init__(self, function: PerfectHash, slots: np.ndarray):
        self.function, self.table = function, slots

    def write(self, folder: str, number: int) -> None:
        file = _NewFile(folder, f"index-{number:06d}.mph")
        sizes = [len(b) for b in self.function.levels]
        file.out.write(struct.pack("<qi", len(self.table), len(sizes)) + np.array(sizes, "<i8").tobytes())
        for bits in self.function.levels:
            file.out.write(np.packbits(bits).tobytes())
        file.out.write(self.table.tobytes())
        file.close()

    @classmethod
    def read(cls, folder: str, number: int) -> Segment:
        fs, root = _place(folder)
        with fs.open_input_file(f"{root}/index-{number:06d}.mph") as f:
            data = f.read()
        n, n_levels = struct.unpack_from("<qi", data)
        sizes, at, levels = np.frombuffer(data, "<i8", n_levels, 12), 12 + 8 * n_levels, []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(PerfectHash(levels), np.frombuffer(data, _SLOT, n, at))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the index holds (their fingerprints agree), and the slots' contents of those."""
        slots = self.function.slots(keys)
        held = slots >= 0
        held[held] = self.table["print"][slots[held]] == fingerprints(keys[held])
        return held, self.table[slots[held]]


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal ``segment`` in sorted batches; a segment is of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        column = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and held[0].column(0)[0].as_py() != int(column[low]):
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _build_index(folder: str, batches):
    for number, rows in _by_segment(batches):
        keys = rows.column("key").to_numpy()
        function = PerfectHash.build(keys)
        slots, at = np.zeros(len(keys), _SLOT), function.slots(keys)
        slots["print"][at] = fingerprints(keys)
        for name in ("shard", "record", "shards"):
            slots[name][at] = rows.column(name).to_numpy()
        Segment(function, slots).write(folder, number)
        yield pa.RecordBatch.from_pydict({"segment": [number], "keys": [len(keys)]}, schema=pa.schema([("segment", pa.int64()), ("keys", pa.int64())]))


def _segment(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).alias("segment")


def write_store(
    docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    added: bool = False,
) -> dict:
    """Encode all texts, write shards in ascending doc_id order and the index; returns the manifest, also in ``folder``.

    Documents are range-shuffled by key as text (smaller than its ids); each task encodes its range and streams it to its
    shard. Ids take two bytes where the vocabulary allows. The result depends on the data only, so a task that runs again
    writes the same file. Null texts are empty, null doc_ids get ``NULL_KEY``; records of one key are neighbours, by text within
    a shard. A key with very many records runs on over several shards, cut by a hash of the text, and the index has it once
    with its first record and the number of shards; only records equal in key and text stay in one. ``added`` encodes the vocabulary's added tokens as the library
    does by itself, and so do the query and the stage; without it they are plain text (see ``Encoder``). An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ordered = rows.repartitionByRange("key", F.xxhash64("body")).sortWithinPartitions("key", "body")
    schema = "key long, shard long, record long, first long, n_tokens long"
    records = staged(ordered.mapInArrow(partial(_write_shards, folder, vocabulary, end_id, added), schema), "records")
    # Shard and record as one number, so that their minimum is the first place.
    places = records.groupBy("key").agg(F.min(F.shiftleft("shard", 40) + F.col("record")).alias("first"), F.max("shard").alias("last"))
    shard, record = F.shiftright("first", 40), F.col("first").bitwiseAND(F.lit((1 << 40) - 1))
    keys = staged(places.select("key", shard.alias("shard"), record.alias("record"), (F.col("last") - shard + 1).alias("shards")), "keys")
    segments = max(1, -(-keys.count() // KEYS_PER_SEGMENT))
    dealt = keys.select(_segment(segments), "*").repartition("segment").sortWithinPartitions("segment")
    staged(dealt.mapInArrow(partial(_build_index, folder), "segment long, keys long"), "segments").count()
    bases = records.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bases.write.parquet(f"{folder}/shards.parquet")
    manifest = {"segments": segments, "vocabulary": vocabulary.rsplit("/", 1)[-1], "end_id": end_id, "added": added}
    fs, root = _place(folder)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _look_up(folder: str, batches):
    for number, rows in _by_segment(batches):
        segment, keys = Segment.read(folder, number), rows.column("key").to_numpy()
        held, slots = segment.find(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[held]), *[pa.array(slots[c].astype(np.int64)) for c in ("shard", "record", "shards")]],
            names=["key", "shard", "record", "shards"])


def _fetch(folder: str, batches):
    shard, number = None, None
    names = ["key", "shard", "first", "n_tokens", "ids_crc32"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

    for batch in batches:
        out = []
        for key, s, record in zip(*[c.to_pylist() for c in batch.columns]):
            if s != number:
                shard, number = Shard(folder, s), s
            # None at all for a key that isn't stored but has a stored key's slot and fingerprint.
            for r in range(record, int(np.searchsorted(shard.keys, key, "right"))):
                crc = zlib.crc32(shard.ids(r).astype("<u4").tobytes())
                out.append((key, s, int(shard.starts[r]), int(shard.counts[r]), crc))
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)


def read_store(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the keys (column key), by the index and the shards alone.

    Keys that the store doesn't hold give no row.
    """
    spark = keys.sparkSession
    fs, root = _place(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dealt = keys.select(_segment(manifest["segments"]), "key").repartition("segment").sortWithinPartitions("segment")
    found = dealt.mapInArrow(partial(_look_up, folder), "key long, shard long, record long, shards long")
    # A key's records go on at the beginning of the next shard.
    parts = found.select("key", F.posexplode(F.sequence("shard", F.col("shard") + F.col("shards") - 1)).alias("i", "shard"), "record")
    parts = parts.select("key", "shard", F.when(F.col("i") == 0, F.col("record")).otherwise(F.lit(0)).cast("long").alias("record"))
    by_shard = parts.repartition("shard").sortWithinPartitions("shard", "record")
    got = by_shard.mapInArrow(partial(_fetch, folder), "key long, shard long, first long, n_tokens long, ids_crc32 long")
    bases = spark.read.parquet(f"{folder}/shards.parquet")  # one row a shard
    return got.join(bases, "shard").select(
        F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Write the documents as a token store in the shared folder and read every one back through the index."""
    store = shared_folder(spark, "tokens")
    write_store(docs, store, added=True)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    return read_store(keys, store)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, table(spark, folder, "documents"), folder)
