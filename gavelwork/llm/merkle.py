"""Merkle manifest of a dataset: leaves find their places by rank in merged bitmaps of ids, and
keyed slot arrays of digests are reduced level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.llm.common import lower_ascii, saved

FANOUT = 8
#: Levels of a slot array: one row of a task holds FANOUT ** LEVELS nodes.
LEVELS = 4
SLOTS = FANOUT ** LEVELS
#: Ids of a container share all but their last bits.
LOW_BITS = 12
#: Containers up to this many ids list them in two bytes each, larger ones are a bitmap.
SPARSE = (1 << LOW_BITS) // 16
#: Bits of a container's number that a level of the directory takes off.
LEVEL_BITS = 18
#: Bits under one entry of a popcount directory.
WORD = 64
#: Container of rows without an id, before all others.
NO_ID = -(1 << (63 - LOW_BITS)) - 1
#: Containers that a task holds before it gives them out.
HELD = 256
PATH = "array<struct<before: string, after: string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


# Digests and paths, as lowercase hex text

def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(leaves: list[str], levels: int) -> list[list[str]]:
    """A slot array and the levels above it; nodes are reduced in runs of FANOUT, the last one may be shorter."""
    out = [leaves]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i:i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def siblings(level: list[str]) -> list[tuple[str, str]]:
    """For every node of a level the digests before and after it in its run, joined."""
    out = []
    for begin in range(0, len(level), FANOUT):
        run = level[begin:begin + FANOUT]
        out += [("".join(run[:i]), "".join(run[i + 1:])) for i in range(len(run))]
    return out


def array_paths(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """What stands beside every slot of an array and beside its ancestors, level by level."""
    beside = [siblings(level) for level in reduced(leaves, levels)[:levels]]
    for place in range(len(leaves)):
        yield [beside[k][place // FANOUT ** k] for k in range(levels)]


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and a path lead to."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


# Leaves

def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


# Bitmaps of ids

def container(counts: np.ndarray) -> bytes:
    """Rows by the low bits of their id, compressed: a list of ids or a bitmap, then the ids of
    several rows with the number of further rows."""
    ids, more = np.flatnonzero(counts), np.flatnonzero(counts > 1)
    if len(ids) <= SPARSE:
        body = ids.astype("<u2").tobytes()
    else:
        body = np.packbits(np.pad(counts > 0, (0, (1 << LOW_BITS) - len(counts))), bitorder="little").tobytes()
    head = np.array([len(ids), len(more)], "<u4").tobytes()
    return head + body + more.astype("<u2").tobytes() + (counts[more] - 1).astype("<i8").tobytes()


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Listed ids or bitmap words of a container, its ids of several rows and their further rows."""
    n, several = np.frombuffer(blob, "<u4", 2).tolist()
    kind, size = ("<u2", n) if n <= SPARSE else ("<u8", (1 << LOW_BITS) // WORD)
    body = np.frombuffer(blob, kind, size, 8)
    at = 8 + body.nbytes
    return body, np.frombuffer(blob, "<u2", several, at), np.frombuffer(blob, "<i8", several, at + 2 * several)


def add_counts(blob: bytes, counts: np.ndarray) -> None:
    body, more, further = opened(blob)
    if body.dtype.itemsize == 2:
        counts[body] += 1
    else:
        counts += np.unpackbits(body.view(np.uint8), bitorder="little")
    counts[more] += further


def ranks(blob: bytes, low: np.ndarray) -> np.ndarray:
    """Rows of a container before each of its ids: the ids before it, of a bitmap by the popcount
    directory and the popcount within the word, and the further rows of those ids."""
    body, more, further = opened(blob)
    if body.dtype.itemsize == 2:
        rank = np.searchsorted(body, low)
    else:
        directory = np.concatenate([[0], np.cumsum(np.bitwise_count(body), dtype=np.int64)])
        below = (np.uint64(1) << (low % WORD).astype(np.uint64)) - np.uint64(1)
        rank = directory[low // WORD] + np.bitwise_count(body[low // WORD] & below)
    return rank + np.concatenate([[0], np.cumsum(further)])[np.searchsorted(more, low)]


def _runs(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    n = len(columns[0])
    if n:
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        yield from zip([0, *new.tolist()], [*new.tolist(), n], strict=True)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of the ids (tree, bucket, low) of one task."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        keys, blobs = list(held), [container(c) for c in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                           pa.array(blobs, pa.binary())], names=["tree", "bucket", "blob"])

    for batch in batches:
        tree, bucket, low = (np.asarray(c) for c in batch.columns)
        together = np.lexsort((bucket, tree))
        tree, bucket, low = tree[together], bucket[together], low[together]
        for a, b in _runs([tree, bucket]):
            key, own = (int(tree[a]), int(bucket[a])), np.bincount(low[a:b])
            known = held.get(key, own[:0])
            if len(known) < len(own):
                known, own = own, known
            known[:len(own)] += own
            held[key] = known
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, bucket, n, blob, several) of every key, whose partial containers come one after the other."""
    key, counts, rows = None, np.zeros(1 << LOW_BITS, np.int64), []
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("low", pa.int64()), ("place", pa.int64())]))]

    def close() -> None:
        blob, more = container(counts), np.flatnonzero(counts > 1)
        several = [{"low": a, "place": b} for a, b in zip(more.tolist(), ranks(blob, more).tolist(), strict=True)]
        rows.append((*key, int(counts.sum()), blob, several))
        counts[:] = 0

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["tree", "bucket", "n", "blob", "several"])
        rows.clear()
        return batch

    for batch in batches:
        for tree, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (tree, bucket) != key:
                if key is not None:
                    close()
                key = (tree, bucket)
            add_counts(blob, counts)
            if len(rows) >= HELD:
                yield out()
    if key is not None:
        close()
        yield out()


def bitmaps(ids: DataFrame) -> DataFrame:
    """(tree, bucket, n, blob, several) from ids (tree, bucket, low): each task makes compressed bitmaps
    of its own ids, which are merged by key. ``n`` counts rows, ``several`` lists the ids of several rows."""
    parts = ids.select("tree", "bucket", "low").mapInArrow(_partial, "tree long, bucket long, blob binary")
    together = parts.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket")
    return together.mapInArrow(_merged, "tree long, bucket long, n long, blob binary, several array<struct<low: long, place: long>>")


def directory(containers: DataFrame) -> DataFrame:
    """(tree, bucket, base): rows of the tree before each container.

    Counts are added up in three levels of at most 2 ** LEVEL_BITS entries below one another, so that
    no window holds more, however the ids are spread.
    """
    def parent(name: str) -> Column:
        return F.shiftright(name, LEVEL_BITS)

    def before(keys: list[str], order: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")

    low = containers.select("tree", "bucket", "n", parent("bucket").alias("middle"))
    middle = low.groupBy("tree", "middle").agg(F.sum("n").alias("n")).withColumn("top", parent("middle"))
    top = middle.groupBy("tree", "top").agg(F.sum("n").alias("n"))
    top = top.select("tree", "top", before(["tree"], "top").alias("a"))
    middle = middle.select("tree", "middle", "top", before(["tree", "top"], "middle").alias("b")).join(top, ["tree", "top"])
    low = low.select("tree", "bucket", "middle", before(["tree", "middle"], "bucket").alias("c")).join(middle, ["tree", "middle"])
    return low.select("tree", "bucket", (F.col("a") + F.col("b") + F.col("c")).alias("base"))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of rows (tree, bucket, kind, low, base, item): the container (kind 0) comes before its rows."""
    blob, base = b"", 0
    for batch in batches:
        tree, bucket, kind, low = (np.asarray(batch.column(i)) for i in range(4))
        places = np.zeros(batch.num_rows, np.int64)
        for a, b in _runs([tree, bucket, kind]):
            if kind[a] == 0:
                base, blob = batch.column(4)[a].as_py(), batch.column(5)[a].as_py()
            else:
                places[a:b] = base + ranks(blob, low[a:b])
        rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(places), batch.column(5)], names=["tree", "place", "item"])
        yield rows.filter(pa.array(kind == 1))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (tree, id, item) of a stored table as (tree, place, item), and (tree, n).

    The place is the number of rows of the tree with a smaller id, nulls first. Rows that repeat an
    id lie by their item. Ids are not sorted: rows meet the container of their id and ask for its rank.
    """
    low = F.coalesce(F.col("id").bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")), F.lit(0).cast("long"))
    keyed = rows.select("tree", F.coalesce(F.shiftright("id", LOW_BITS), F.lit(NO_ID)).alias("bucket"), low.alias("low"), "item")
    containers = saved(bitmaps(keyed), "bitmaps")
    sizes = containers.groupBy("tree").agg(F.sum("n").alias("n"))
    based = containers.join(directory(containers), ["tree", "bucket"])
    ids = ["tree", "bucket", "low"]
    several = saved(based.select("tree", "bucket", "base", F.inline("several")).select(*ids, (F.col("base") + F.col("place")).alias("first")), "several")
    none = several.isEmpty()
    lone = keyed if none else keyed.join(several, ids, "left_anti")
    asked = based.select(
        "tree", "bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("low"), "base", F.col("blob").alias("item"),
    ).unionByName(lone.select("tree", "bucket", F.lit(1).alias("kind"), "low", F.lit(None).cast("long").alias("base"), "item"))
    met = asked.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "kind")
    one = met.mapInArrow(_ranked, "tree long, place long, item binary")
    if none:
        return one, sizes
    # rows of one id are counted by the first bytes of their item and then within those
    repeats = keyed.join(several, ids).withColumn("head", F.substring("item", 1, 2))
    whole = Window.partitionBy(*ids).orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = repeats.groupBy(*ids, "head").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(whole) - F.col("n")).drop("n")
    order = F.row_number().over(Window.partitionBy(*ids, "head").orderBy("item"))
    many = repeats.withColumn("order", order).join(heads, [*ids, "head"])
    return one.unionByName(many.select("tree", (F.col("first") + F.col("before") + F.col("order") - 1).alias("place"), "item")), sizes


# Slot arrays

def depth(n: Column) -> Column:
    """Levels until one node of n remains."""
    levels = F.lit(21)
    for k in range(20, -1, -1):
        levels = F.when(n <= FANOUT ** k, F.lit(k)).otherwise(levels)
    return levels


def slot_arrays(nodes: DataFrame) -> DataFrame:
    """(tree, chunk, depth, slots, root) from nodes (tree, place, depth, item), whose item begins with the
    32 bytes of a digest: SLOTS consecutive nodes in one row, each in its slot, and the digest that
    they are reduced to."""
    slot = F.struct(F.pmod("place", F.lit(SLOTS)).cast("int").alias("slot"), "item")
    arrays = nodes.groupBy("tree", F.floor(F.col("place") / SLOTS).cast("long").alias("chunk"), "depth").agg(F.collect_list(slot).alias("slots"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                entries = row.column(3).flatten()
                slots, items = entries.field("slot").to_pylist(), entries.field("item").to_pylist()
                array = [b""] * len(items)
                for slot, item in zip(slots, items, strict=True):
                    array[slot] = item
                root = reduced([i[:32].hex() for i in array], min(LEVELS, row.column(2)[0].as_py()))[-1][0]
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), pa.array([array], pa.list_(pa.binary())), pa.array([root])],
                                                 names=["tree", "chunk", "depth", "slots", "root"])

    return arrays.mapInArrow(rooted, "tree long, chunk long, depth int, slots array<binary>, root string")


def _as_path(steps: list[tuple[str, str]]) -> list[dict]:
    return [{"before": b, "after": a} for b, a in steps]


def chunk_paths(arrays: DataFrame) -> DataFrame:
    """(tree, chunk, path, root) of stored slot arrays: from the array's own root to the root of its tree."""
    upper = arrays.filter(F.col("depth") > LEVELS)
    done = arrays.filter(F.col("depth") <= LEVELS).select("tree", "chunk", F.array().cast(PATH).alias("path"), "root")
    if upper.isEmpty():
        return done
    nodes = upper.select("tree", F.col("chunk").alias("place"), (F.col("depth") - LEVELS).alias("depth"), F.unhex("root").alias("item"))
    return done.unionByName(node_paths(nodes).withColumnRenamed("place", "chunk"))


def node_paths(nodes: DataFrame) -> DataFrame:
    """(tree, place, path, root) of nodes (tree, place, depth, item)."""
    arrays = saved(slot_arrays(nodes), "slots")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tree, chunk, levels, slots, path, root = (c[at].as_py() for c in batch.columns)
                own, n = array_paths([s[:32].hex() for s in slots], min(LEVELS, levels)), len(slots)
                yield pa.RecordBatch.from_arrays([
                    pa.array([tree] * n), pa.array(range(chunk * SLOTS, chunk * SLOTS + n)),
                    pa.array([_as_path(steps) + path for steps in own], _PATH), pa.array([root] * n),
                ], names=["tree", "place", "path", "root"])

    met = arrays.drop("root").join(chunk_paths(arrays), ["tree", "chunk"]).select("tree", "chunk", "depth", "slots", "path", "root")
    return met.mapInArrow(spread, f"tree long, place long, path {PATH}, root string")


def numbered(values: DataFrame) -> DataFrame:
    """(value, tree): the different values of a one-column table in ascending order from 0, nulls first."""
    name = values.columns[0]
    ordered = saved(values.distinct().orderBy(F.col(name).asc_nulls_first()).select(
        F.col(name).alias("value"), F.monotonically_increasing_id().alias("at")), "groups")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    ordered = ordered.select("value", F.shiftright("at", 33).alias("part"), within.alias("within"))
    so_far = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row per partition
    before = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", (so_far - F.col("n")).alias("before"))
    return ordered.join(before, "part").select("value", (F.col("before") + F.col("within")).alias("tree"))


def _proved(arrays: DataFrame, with_paths: bool) -> DataFrame:
    """One row per leaf from (tree, chunk, depth, slots, path, subroot, root)."""
    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                levels, slots, above, subroot, root = (batch.column(i)[at].as_py() for i in range(2, 7))
                above = [(p["before"], p["after"]) for p in above]
                rest = "".join(b + a for b, a in above)
                leaves = [s[:32].hex() for s in slots]
                ids, proofs, folds, own = [], [], [], []
                for item, leaf, steps in zip(slots, leaves, array_paths(leaves, min(LEVELS, levels)), strict=True):
                    again = item[33:65].hex() if item[32] else leaf
                    number = item[65 if item[32] else 33:]
                    ids.append(int.from_bytes(number, "big", signed=True) if number else None)
                    proofs.append(digest("".join(b + a for b, a in steps) + rest))
                    folds.append(folded(again, steps + above))
                    own.append(_as_path(steps + above) if with_paths else None)
                n = len(slots)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds),
                    pa.array([f == root for f in folds]), pa.array(own, _PATH),
                ], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"])

    out = arrays.select("tree", "chunk", "depth", "slots", "path", "subroot", "root").mapInArrow(
        proved, f"doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path {PATH}")
    return out if with_paths else out.drop("path")


def manifest(docs: DataFrame, tampered: Column | None = None, with_paths: bool = True,
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "lang",
             text: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path) of every row.

    A leaf is the digest of the row's fields. The leaves of a group, by ascending id, are reduced in
    runs of FANOUT to the group's subroot, and the subroots, in the order of their groups (null
    first), to the root. ``path`` has the digests beside the leaf and beside its ancestors; they
    are what ``proof_sha256`` is the digest of. ``tampered`` is a condition on rows whose text is read once more
    with A-Z in lower case; ``folded_root`` is the root that this reading leads to.

    A null field has a mark of its own. Rows with a null id come first in their group. Rows that
    repeat an id lie by their leaf, and each has a place of its own, equal rows too. A null
    condition is false. Other columns are ignored; an empty table gives no rows.
    """
    def columns(changed: bool) -> list[Column]:
        named = {n: F.col(f"`{n}`") for n in fields}
        if changed and text in named:
            named[text] = lower_ascii(named[text].cast("string"))
        return list(named.values())

    again = F.when(F.lit(False) if tampered is None else tampered, leaf_digest(columns(True)))
    leaves = saved(docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{group}`").cast("string").alias("group"), leaf_digest(columns(False)).alias("leaf"),
        again.alias("again"),
    ), "leaves")
    groups = saved(numbered(leaves.select("group")), "trees")
    # an item is the leaf, a byte that tells whether the leaf as read once more follows, and the id if there is one
    item = F.concat("leaf", F.coalesce(F.concat(F.lit(b"\x01"), "again"), F.lit(b"\x00")), F.coalesce(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.lit(b"")))
    keyed = leaves.join(groups, leaves["group"].eqNullSafe(groups["value"])).select("tree", "id", item.alias("item"))
    rows, sizes = placed(keyed)
    arrays = saved(slot_arrays(rows.join(sizes.select("tree", depth(F.col("n")).alias("depth")), "tree")), "slots")
    inner = saved(chunk_paths(arrays), "paths")
    subroots = inner.filter("chunk = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), depth(F.lit(groups.count())).alias("depth"),
                                                F.unhex("root").alias("item"))
    tops = saved(node_paths(subroots), "tops").select(F.col("place").alias("tree"), F.col("path").alias("top"), F.col("root").alias("whole"))
    paths = inner.join(tops, "tree").select("tree", "chunk", F.concat("path", "top").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root"))
    return _proved(arrays.drop("root").join(paths, ["tree", "chunk"]), with_paths)
