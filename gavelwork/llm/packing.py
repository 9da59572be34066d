"""Packing of tokenised documents into sequences: best-fit decreasing on a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelwork.llm import words
from gavelwork.llm.common import freeing, give_back, saved, small_batches, text_or_empty
from gavelwork.llm.token_files import END_ID
from gavelwork.llm.tokens import encoder

#: Ids in a sequence.
WINDOW = 4096
#: Pieces that are packed together; the sequences of every group but its last few are full.
GROUP_PIECES = 40_000
#: Bytes of a batch of texts that is cut: about one step of the encoder (``words.STEP_BYTES``).
BATCH_BYTES = 5 << 20


class Windows:
    """Open windows by remaining capacity; ``take`` gives the tightest one that holds a length.

    A segment tree over the capacities 0 to ``size`` tells which capacities have open windows:
    a leaf is the number of them, an inner node the sum of its children.
    """

    def __init__(self, size: int):
        self.size, self.half = size, 1 << size.bit_length()
        self.counts = [0] * (2 * self.half)
        self.open: dict[int, list[int]] = {}
        self.n = 0

    def _add(self, capacity: int, by: int) -> None:
        node = self.half + capacity
        while node:
            self.counts[node] += by
            node >>= 1

    def _tightest(self, length: int) -> int | None:
        """Smallest capacity of at least ``length`` that has an open window."""
        counts, node = self.counts, self.half + length
        if counts[node]:
            return length
        while node > 1:
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.half:
                    node = 2 * node if counts[2 * node] else 2 * node + 1
                return node - self.half
            node >>= 1
        return None

    def take(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece; a new window if it fits in no open one."""
        capacity = self._tightest(length)
        if capacity is None:
            window, capacity = self.n, self.size
            self.n += 1
        else:
            window = self.open[capacity].pop()
            self._add(capacity, -1)
        left = capacity - length
        if left:
            self.open.setdefault(left, []).append(window)
            self._add(left, 1)
        return window, self.size - capacity


def best_fit(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of pieces given by descending length."""
    windows = Windows(size)
    places = [windows.take(n) for n in lengths.tolist()]
    return np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, place long"


def cut(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW,
        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of whole documents: full windows of overlong ones, and what is left of each.

    ``ids`` are unsigned 32-bit little-endian numbers, ``place`` numbers the pieces of a run.
    Null and empty texts are one piece with the end id. Repeated rows give pieces of their
    own. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
        ("ids", pa.binary()), ("place", pa.int64()),
    ])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), words.as_array(batch.column(1))
            for begin, end in words.steps(texts):
                bounds, ids = coder.encode(texts.slice(begin, end - begin))
                out: dict[str, list] = {name: [] for name in schema.names}
                for i in range(end - begin):
                    one = np.append(ids[bounds[i]:bounds[i + 1]], coder.dtype.type(end_id)).astype("<u4")
                    for start in range(0, len(one), window):
                        part = one[start:start + window]
                        for name, value in zip(schema.names, (keys[begin + i], start, len(part), len(one), part.tobytes(), n), strict=True):
                            out[name].append(value)
                        n += 1
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return rows.mapInArrow(freeing(pieces), PIECES)


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every piece once, none cut, no gap.

    Pieces (``start``, ``length`` up to ``window``, ``place`` and any other columns) are dealt by
    a hash of document and place into groups of about ``group``, whatever document they are of;
    each group is packed on its own by best-fit decreasing. Ties go by document, start and place.
    An empty table gives no rows. ``pieces`` is read twice, so it should be a stored table.
    """
    groups = max(1, -(-pieces.count() // group))
    names = pieces.columns
    order = [n for n in ("doc_id", "start", "place") if n in names]

    def one_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *order], ascending=[False, *[True] * len(order)], kind="stable")
        at, offset = best_fit(rows["length"].to_numpy(), window)
        found = rows[names].assign(sequence_id=at * groups + int(key[0]), offset=offset)
        del rows
        give_back()
        return found

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(one_group, schema)


def stored_pieces(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Pieces as a table of the shared folder."""
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return saved(cut(docs, tokenizer, **options), "pieces")


def packed_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Packed pieces with the crc32 of their ids in place of the ids."""
    rows = stored_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(packed: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Rows to train on, from packed pieces with their ids: (sequence_id, length, padded, ids).

    A sequence whose length is a power of two stays as it is, others are padded to ``window``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
    )
    whole = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    padded = F.when(whole, F.col("length")).otherwise(window)
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (padded - F.col("length")).cast("int")))
    return rows.select("sequence_id", "length", padded.cast("long").alias("padded"), F.concat("ids", pad).alias("ids"))
