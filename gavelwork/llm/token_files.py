"""Token files: raw id payloads in shards, found through a minimal perfect hash of document keys.

A shard is two files. ``*.ids`` holds the ids of its documents one after another, little-endian,
two bytes each if the vocabulary allows it. ``*.idx`` is a sequence of NumPy arrays: levels and
bits of the hash, and for each of its slots a fingerprint of the key, the offset and the number
of ids; then the keys in ascending order, for full scans. The table ``manifest`` lists the shards
with their key range; shards that it does not list (left by lost tasks) do not exist.

The hash places keys level by level in a bit array of twice as many bits; keys that are alone on
their bit stay, the others go to the next level. The rank of a key's bit is its slot, so n keys
have the slots 0 to n - 1 and a lookup reads a constant number of words. A key that was never
stored is refused by its 32-bit fingerprint but for one in four billion.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelwork.llm import words
from gavelwork.llm.common import text_or_empty
from gavelwork.llm.tokens import encoder

#: A shard is closed beyond so many ids.
SHARD_IDS = 32_000_000
#: Id that ends every document.
END_ID = 2
MANIFEST = "part int, shard int, path string, width int, first_id long, last_id long, n_docs long, n_ids long"


# -- minimal perfect hash ----------------------------------------------------------------------


def _mix(low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of a key of two 64-bit words."""
    with np.errstate(over="ignore"):
        x = low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD6E8FEB86659FD93)
        for more in (high.astype(np.uint64), np.uint64(0)):
            x ^= more + np.uint64(seed + 1)
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return x


class PerfectHash:
    """Slots 0 to n - 1 for n different keys (pairs of 64-bit words)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # words of 64 bits of each level, and all words
        self.starts = np.cumsum(sizes) - sizes
        self.ranks = np.cumsum(np.bitwise_count(bits).astype(np.int64)) - np.bitwise_count(bits)

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(low):
            n = (2 * len(low) + 63) // 64
            at = (_mix(low, high, level) % np.uint64(64 * n)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * n)[at] == 1
            field = np.zeros(64 * n, np.uint8)
            field[at[alone]] = 1
            parts.append(np.packbits(field, bitorder="little").view("<u8"))
            sizes.append(n)
            low, high, level = low[~alone], high[~alone], level + 1
            if level > 200:
                raise ValueError("keys are not different")
        bits = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), bits)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or a slot of another key, for keys that were not given."""
        out, open_ = np.full(len(low), -1, np.int64), np.arange(len(low))
        for level, (n, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            at = (_mix(low[open_], high[open_], level) % np.uint64(64 * n)).astype(np.int64)
            word, bit = start + at // 64, (at % 64).astype(np.uint64)
            held = self.bits[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.ranks[word] + below)[hit]
            open_ = open_[~hit]
        return out


def _fingerprint(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (_mix(low, high, 1 << 20) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _key(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key words of documents: the id, and which of the rows of this id it is."""
    return ids.astype(np.int64).view(np.uint64), (nth.astype(np.uint64) << np.uint64(1)) | null.astype(np.uint64)


# -- writing -------------------------------------------------------------------------------------


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Shard:
    """One shard being written; holds the index of its documents, not their ids."""

    def __init__(self, folder: str, part: int, shard: int, width: int):
        self.part, self.shard, self.width, self.n_ids = part, shard, width, 0
        self.path = f"{folder}/shard-{part:06d}-{shard:04d}-{uuid.uuid4().hex[:12]}"
        self.files, self.base = _files(self.path)
        self.stream = self.files.open_output_stream(self.base + ".ids")
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.stream.write(memoryview(ids).cast("B"))
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)

    def close(self) -> dict:
        self.stream.close()
        null = np.array([i is None for i in self.ids], np.uint8)
        keys = np.array([0 if i is None else i for i in self.ids], np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
        place = np.arange(len(keys))
        nth = place - np.maximum.accumulate(np.where(new, place, 0))
        lengths = np.array(self.lengths, np.int64)
        low, high = _key(keys, null, nth)
        table = PerfectHash.build(low, high)
        slots = table.slots(low, high)
        prints, offsets, counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        prints[slots], offsets[slots], counts[slots] = _fingerprint(low, high), np.cumsum(lengths) - lengths, lengths
        with self.files.open_output_stream(self.base + ".idx") as stream:
            for array in (table.sizes, table.bits, prints, offsets, counts, keys, null, nth):
                buffer = io.BytesIO()
                np.save(buffer, array, allow_pickle=False)
                stream.write(buffer.getvalue())
        known = [i for i in self.ids if i is not None]
        return {
            "part": self.part, "shard": self.shard, "path": self.path, "width": self.width,
            "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
            "n_docs": len(keys), "n_ids": self.n_ids,
        }


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them as token files in ascending key order; the manifest.

    Null texts are empty, so their document is the end id alone. Null keys come first. Rows
    with the same key are stored all, told apart by their place among them. An empty table
    gives a manifest without shards. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part, done, shard = TaskContext.get().partitionId(), [], None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), words.as_array(batch.column(1))
            for begin, end in words.steps(texts):
                bounds, ids = coder.encode(texts.slice(begin, end - begin))
                for i in range(end - begin):
                    if shard is None:
                        shard = _Shard(folder, part, len(done), coder.dtype.itemsize)
                    one = np.append(ids[bounds[i]:bounds[i + 1]], coder.dtype.type(end_id))
                    shard.add(keys[begin + i], one)
                    if shard.n_ids >= shard_ids:
                        done.append(shard.close())
                        shard = None
        if shard is not None:
            done.append(shard.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)

    found = ordered.mapInArrow(shards, MANIFEST)
    found.write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


_MANIFEST = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()),
    ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in key order with ``start``, the ids in all shards before; a row per shard."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


# -- reading -------------------------------------------------------------------------------------


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str, width: int):
        self.files, self.base = _files(path)
        self.dtype = np.dtype(f"<u{width}")
        with self.files.open_input_stream(self.base + ".idx") as stream:
            buffer = io.BytesIO(stream.read())
        sizes, bits, self.prints, self.offsets, self.counts, self.keys, self.null, self.nth = (
            np.load(buffer, allow_pickle=False) for _ in range(8)
        )
        self.table = PerfectHash(sizes, bits)

    def find(self, ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of ids of each key; -1 and 0 for keys that are not here."""
        low, high = _key(ids, null, nth)
        slots = self.table.slots(low, high)
        there = slots >= 0
        there[there] = self.prints[slots[there]] == _fingerprint(low, high)[there]
        slots = np.where(there, slots, 0)
        if not len(self.prints):
            return np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        return np.where(there, self.offsets[slots], -1), np.where(there, self.counts[slots], 0)

    def read(self, file, offset: int, count: int) -> np.ndarray:
        file.seek(offset * self.dtype.itemsize)
        return np.frombuffer(file.read(count * self.dtype.itemsize), self.dtype)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of one document, None if it is not here."""
        offset, count = self.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]))
        if offset[0] < 0:
            return None
        with self.files.open_input_file(self.base + ".ids") as file:
            return self.read(file, int(offset[0]), int(count[0]))


#: Ids read and given on at a time.
READ_IDS = 2_000_000


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every stored document, each found through the hash: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian numbers) and,
    if asked for, the ids in that form."""
    shards = manifest(spark, folder)
    tasks = max(1, shards.count())
    out = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
        *([("ids", pa.binary())] if with_ids else []),
    ])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["width"])
                offsets, counts = shard.find(shard.keys, shard.null, shard.nth)
                with shard.files.open_input_file(shard.base + ".ids") as file:
                    at = 0
                    while at < len(offsets):
                        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS)))
                        wide = shard.read(file, int(offsets[at]), int(counts[at:end].sum())).astype("<u4")
                        begin = offsets[at:end] - offsets[at]
                        parts = [memoryview(wide[b:b + n]).cast("B") for b, n in zip(begin, counts[at:end], strict=True)]
                        columns = [
                            pa.array(shard.keys[at:end], pa.int64(), mask=shard.null[at:end].astype(bool)),
                            pa.array(row["start"] + offsets[at:end]),
                            pa.array(counts[at:end]),
                            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        ]
                        if with_ids:
                            columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, schema=out)
                        at = end

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return shards.select("path", "width", "start").repartition(tasks).mapInArrow(documents, kinds)


def find(spark: SparkSession, folder: str, doc_id: int | None) -> np.ndarray | None:
    """Ids of one document, reading the manifest, one index and the payload of that document."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    ordered = rows.orderBy("part", "shard")
    near = ordered.limit(1) if doc_id is None else ordered.filter(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    for row in near.select("path", "width").toLocalIterator():
        ids = Shard(row["path"], row["width"]).get(doc_id)
        if ids is not None:
            return ids
    return None
