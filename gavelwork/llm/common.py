"""Tables in the shared folder, text columns, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import get_ident

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelwork.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: By thread, the paths of the tables that go at the end of each open ``scratch`` block, the innermost last;
#: plain lists, as what is sent to tasks by value takes it along.
_passing: dict[int, list[list[str]]] = {}


def saved(rows: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """The rows as a table of the shared folder: later steps read it, whatever executor is lost."""
    path = scratch_path(rows.sparkSession, name)
    if not stays and _passing.get(get_ident()):
        _passing[get_ident()][-1].append(path)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved inside the block are removed at its end, unless they are to stay: what
    the block returns reads from those and from its input alone."""
    paths: list[str] = []
    _passing.setdefault(get_ident(), []).append(paths)
    try:
        yield
    finally:
        _passing[get_ident()].pop()
        for path in paths:
            remove(spark, path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Batches of about ``size`` bytes for the Python tasks of jobs that run inside the block, for rows that
    may be large; elsewhere the number of rows alone limits a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def give_back() -> None:
    """Return to the system what Arrow and the C library of this worker process keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def freeing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task; at its end the worker, which stays for later tasks and stages, keeps
    nothing of what the task has freed."""
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def named_rows(docs: DataFrame) -> DataFrame:
    """(doc, file, place): every row with all its columns and a name that is the same whenever it is read.

    Rows of Parquet files are named by file and index there; the rows of other tables are saved first.
    """
    doc = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc")
    try:
        about = docs.metadataColumn("_metadata")
        return docs.select(doc, about.getField("file_path").alias("file"), about.getField("row_index").alias("place"))
    except AnalysisException:
        return saved(docs.select(doc, F.lit("").alias("file"), F.monotonically_increasing_id().alias("place")), "rows", stays=True)


#: Bytes of rows, as they lie in memory, that a stored table may have to be sent whole to all tasks.
SENT_BYTES = 64 << 20
#: Bytes of a row in memory beside its values: its header, and its entry in the map it is looked up in.
ROW_BYTES = 40


def sized(stored: DataFrame) -> DataFrame:
    """The rows of a stored table for a join that does not send them to all tasks if they take more than ``SENT_BYTES``.

    Spark goes by the bytes of the files, which hold names of files and runs of ids in a fiftieth of what the rows take.
    """
    long = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) for n, kind in stored.dtypes if kind in ("string", "binary")]
    n, more = stored.agg(F.count("*"), F.sum(sum(long, F.lit(0)))).first()
    fits = n * (ROW_BYTES + 8 * len(stored.columns)) + (more or 0) <= SENT_BYTES
    return stored if fits else stored.hint("merge")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; ids that are null are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts, F.lit(0))


def with_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Large-star and small-star steps in turn (Kiveris et al. 2014): every step hangs nodes below
    smaller neighbours, so chains shrink by a constant factor and a node with very many
    neighbours is a plain aggregate. Each round is written to the shared folder. Raises if
    ``rounds`` did not settle. Edges with a null end and loops are left out.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    stars = saved(
        both.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        mirrored = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            mirrored.filter("v > u").join(low, "u").filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = saved(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum("v").cast("string"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
