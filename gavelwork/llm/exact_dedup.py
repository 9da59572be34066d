"""Exact duplicates of normalised text, found with cuckoo-filter indexes over digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.llm.common import freeing, lower_ascii, named_rows, saved, scratch, sized, text_or_empty

SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Live digests with a value each: a cuckoo filter before bucketed content.

    The filter holds a 16-bit fingerprint of a digest in one of two buckets of four slots; the
    second bucket follows from the first and the fingerprint, so entries move without their key.
    Beside each slot the whole digest and its value are stored; a fingerprint that hits is
    verified against them. Digests are inserted and deleted; when an insert finds no room after
    ``KICKS`` moves, the table doubles and is filled again from the stored digests.
    """

    def __init__(self, buckets: int = 1024):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.buckets, self.n = buckets, 0
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.stored: list[list[tuple[bytes, object]]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") % self.buckets
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 % self.buckets)  # buckets are a power of two

    def find(self, digest: bytes) -> object | None:
        """Value of a live digest, None if there is none."""
        print_, first, second = self._places(digest)
        for bucket in (first, second):
            for slot, held in enumerate(self.prints[bucket]):
                if held == print_ and self.stored[bucket][slot][0] == digest:
                    return self.stored[bucket][slot][1]
        return None

    def delete(self, digest: bytes) -> bool:
        print_, first, second = self._places(digest)
        for bucket in (first, second):
            for slot, held in enumerate(self.prints[bucket]):
                if held == print_ and self.stored[bucket][slot][0] == digest:
                    del self.prints[bucket][slot], self.stored[bucket][slot]
                    self.n -= 1
                    return True
        return False

    def insert(self, digest: bytes, value: object) -> None:
        """Add a digest that is not live."""
        entry, (print_, first, second) = (digest, value), self._places(digest)
        bucket = first if len(self.prints[first]) <= len(self.prints[second]) else second
        for kick in range(KICKS):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(print_)
                self.stored[bucket].append(entry)
                self.n += 1
                return
            slot = (print_ + kick) % SLOTS
            self.prints[bucket][slot], print_ = print_, self.prints[bucket][slot]
            self.stored[bucket][slot], entry = entry, self.stored[bucket][slot]
            bucket = self._other(bucket, print_)
        held = [*self.items(), entry]
        self._reset(2 * self.buckets)
        for key, kept in held:
            self.insert(key, kept)

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.stored:
            yield from bucket


_GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_KINDS = "digest binary, keep_id long, keep_row long, group_size long"
#: Live digests of a task that combines its own rows; beyond it the task gives on what it has.
LOCAL_DIGESTS = 200_000


def _newer(doc_id: int | None, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, row)


def _combine(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """One row per digest: a newer document takes the place of the live one."""
    index = CuckooIndex()

    def rows() -> Iterator[pa.RecordBatch]:
        held = list(index.items())
        for at in range(0, len(held), 10_000):
            part = held[at:at + 10_000]
            columns = [pa.array([d for d, _ in part], pa.binary())]
            columns += [pa.array([v[i] for _, v in part], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, schema=_GROUPS)

    for batch in batches:
        for digest, keep, row, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            live = index.find(digest)
            if live is None:
                index.insert(digest, (keep, row, size))
                if limit and index.n >= limit:
                    yield from rows()
                    index = CuckooIndex()
                continue
            if _newer(keep, row) < _newer(*live[:2]):
                keep, row = live[:2]
            index.delete(digest)
            index.insert(digest, (keep, row, size + live[2]))
    yield from rows()


def normal_form(text: str = "text") -> Column:
    """The text with A-Z in lower case; null is empty."""
    return lower_ascii(text_or_empty(text))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normal_form(text), 256))


def groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) from rows (digest, doc_id, row), one per digest.

    Each task first combines its own rows in an index, so a text with very many copies sends
    one row per task; digests are then dealt by hash, and an index per task joins what the
    tasks have sent. The largest id is kept, of equal ids the largest row; nulls are smallest.
    """
    own = digests.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    local = own.mapInArrow(freeing(lambda batches: _combine(batches, LOCAL_DIGESTS)), _KINDS)
    return local.repartition("digest").mapInArrow(freeing(lambda batches: _combine(batches, None)), _KINDS)


def decide(digests: DataFrame) -> DataFrame:
    """Rows (digest, doc_id, row) of a stored table with keep_id, group_size and kept."""
    found = digests.join(groups(digests).filter("group_size > 1"), "digest", "left")
    lone = F.col("group_size").isNull()
    return found.select(
        "digest", "doc_id", "row",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are the same after lower-casing A-Z; null is empty. The row with the
    largest id of each group is kept, and just one of rows that repeat both id and text. Null
    ids are smallest, so a group of null ids has a null ``keep_id``. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    decided = decide(saved(rows, "digests"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns whatever their names.

    The names of the rows to drop are stored; the documents themselves are neither copied nor, while those
    names are few enough to be sent to all tasks, moved.
    """
    rows = named_rows(docs)
    with scratch(docs.sparkSession):
        narrow = saved(rows.select(
            digest(f"doc.`{text}`").alias("digest"), F.col(f"doc.`{doc_id}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
            "file", "place",
        ), "digests")
        found = groups(narrow.select("digest", "doc_id", "row")).filter("group_size > 1")
        dropped = saved(sized(narrow).join(found.select("digest", "keep_row"), "digest").filter("row <> keep_row").select("file", "place"), "dropped", stays=True)
    return rows.join(sized(dropped), ["file", "place"], "left_anti").select("doc.*")
