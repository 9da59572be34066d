"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.llm import words
from gavelwork.llm.common import freeing, named_rows, saved, scratch, sized, small_batches, text_or_empty, with_components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Bytes of text that are hashed in one step.
STEP_BYTES = 3_000_000
#: Fingerprints in one tree; a shard with more is cut into pieces, each with a tree of its own.
TREE_NODES = 4_000
#: Near-dedup of documents: words of a shingle, least Jaccard similarity, and bits within which
#: fingerprints of the shingle sets are compared (at 0.8 they differ in 10 bits on average).
DEDUP_SHINGLE, SIMILARITY, DEDUP_RADIUS = 5, 0.8, 22
#: Least agreement is also asked of two fingerprint words together: bits of 128 (at 0.8 they differ in 19 on average).
DEDUP_WIDE_RADIUS = 38
#: Shards of the near-dedup: fingerprints of WORDS more 64-bit words, cut into WORD_KEYS keys of KEY_BITS bits
#: each. At 0.8 a key agrees with probability 0.14, so all 40 miss 2 pairs in a thousand; at 0.9, 2 in a hundred million.
WORDS, WORD_KEYS, KEY_BITS = 8, 5, 12
#: Fingerprints of one side that are compared with all others of their piece in one step.
SCAN_ROWS = 256
#: Bytes of shingle sets in a piece of a shard whose pairs are checked.
PIECE_BYTES = 8_000_000


def _hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, and the bounds of each text."""
    bounds, codes, distinct = words.split(texts)
    raw = [w.encode() for w in distinct]
    out, sizes = [], np.zeros(len(bounds), np.int64)
    digest, spaced = xxhash.xxh64_intdigest, b" ".join
    for i, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        n = end - begin
        if n:
            own = [raw[c] for c in codes[begin:end].tolist()]
            joined = spaced(own)
            if n <= shingle:
                out.append(digest(joined, SEED))
                sizes[i + 1] = 1
                continue
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            view = memoryview(joined)
            out += [digest(view[a:b], SEED) for a, b in zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)]
            sizes[i + 1] = n - shingle + 1
    return np.array(out, np.uint64), np.cumsum(sizes)


def _majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: the bits that are set in over half of its hashes."""
    size = np.diff(bounds)
    # counts of several bits are summed at once, in lanes of a word wide enough for the longest text
    lane = 16 if size.max(initial=0) < 1 << 16 else 32
    lanes = np.uint64(sum(1 << at for at in range(0, 64, lane)))
    out = np.zeros(len(size), np.uint64)
    for low in range(lane):
        ones = words.sums(((hashes >> np.uint64(low)) & lanes).view(np.int64), bounds).view(np.uint64)
        for at in range(0, 64, lane):
            count = ((ones >> np.uint64(at)) & np.uint64((1 << lane) - 1)).astype(np.int64)
            out |= (2 * count > size).astype(np.uint64) << np.uint64(low + at)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text",
                 row: Column | None = None) -> DataFrame:
    """(doc_id, row, fingerprint) of whole texts, fingerprint as a signed 64-bit number.

    A-Z are lower-cased, words are what stands between ASCII white space, shingles are joined
    by a space and repeats count. Fewer words than a shingle are one shingle; a null or empty
    text has fingerprint zero.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fingerprint", pa.int64())])
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"), text_or_empty(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_array(batch.column(2))
            for begin, end in words.steps(texts, STEP_BYTES):
                marks = _majority(*_hashes(pc.ascii_lower(texts.slice(begin, end - begin)), shingle))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), pa.array(marks.view(np.int64)),
                ], schema=schema)

    return rows.mapInArrow(freeing(hashed), "doc_id long, row long, fingerprint long")


class BKTree:
    """Fingerprints under their parents, by Hamming distance to the parent."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = [value, item, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Items within the radius; only children on edges that can lead there are visited."""
        todo = [self.root] if self.root else []
        while todo:
            own, item, children = todo.pop()
            distance = (own ^ value).bit_count()
            if distance <= radius:
                yield item
            if children:
                for edge in range(distance - radius, distance + radius + 1):
                    child = children.get(edge)
                    if child is not None:
                        todo.append(child)


class Forest:
    """Union-find that tells which links joined two sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, item: int) -> int:
        parent = self.parent
        while parent[item] != item:
            parent[item] = item = parent[parent[item]]
        return item

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _links(values: list[int], side: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that span the components of the values within the radius.

    ``side`` 0 values build the tree; with a side 1, its values only look into that tree (their
    own links are found where they build one).
    """
    tree, forest, out, two = BKTree(), Forest(len(values)), [], 1 in side
    for own in (0, 1):
        for item, value in enumerate(values):
            if side[item] != own:
                continue
            if own == 1 or not two:
                out += [(item, other) for other in tree.near(value, radius) if forest.join(item, other)]
            if own == 0:
                tree.add(value, item)
    return out


def shard_keys(value, radius: int):
    """The keys under which fingerprints within ``radius`` are sure to meet.

    The 64 bits are cut into radius + 2 blocks; at most ``radius`` of them differ, so two are
    equal: one key for each pair of blocks.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n)]
    keys = []
    for i in range(n):
        for j in range(i):
            mask = masks[i] | masks[j]
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(n * i + j).alias("table"), value.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*keys)


def near_links(values: DataFrame, radius: int = RADIUS, nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within ``radius``.

    ``values`` has one row (fingerprint, node) per different fingerprint, in a stored table. Shards
    are fingerprints that agree in two blocks; a shard is sent whole to one task and searched in
    its own BK-tree. A shard beyond ``nodes`` is cut into pieces and every piece meets every other
    in a task of its own, so no task holds more than two pieces. Of the links in a shard only
    those that join two sets are given out.
    """
    keyed = values.select("fingerprint", "node", F.explode(shard_keys(F.col("fingerprint"), radius)).alias("k")).select("fingerprint", "node", "k.*")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shards = keyed.join(sizes, ["table", "key"])
    pieces = F.ceil(F.col("n") / nodes).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), pieces).cast("int")
    dealt = shards.withColumns({"pieces": pieces, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fingerprint", "node",
    )
    spread = dealt.repartition("table", "key", "low", "high").sortWithinPartitions("table", "key", "low", "high", "side", "fingerprint")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        ids = ["table", "key", "low", "high"]

        def close(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[ids].to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, ends = [0, *new.tolist()], [*new.tolist(), len(rows)]
            values, side, nodes = rows["fingerprint"].tolist(), rows["side"].tolist(), rows["node"].tolist()
            values = [v & 0xFFFFFFFFFFFFFFFF for v in values]
            out = []
            for a, b in zip(starts, ends, strict=True):
                if b - a > 1:
                    out += [(nodes[a + i], nodes[a + j]) for i, j in _links(values[a:b], side[a:b], radius)]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(rows):
                continue
            same = (rows[ids] == rows[ids].iloc[-1]).all(axis=1).to_numpy()
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = rows.iloc[last:]
            if last:
                yield close(rows.iloc[:last])
        if rest is not None:
            yield close(rest)

    return spread.mapInPandas(freeing(search), "a long, b long")


def near_groups(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, component_id) of every fingerprint that has a near one or several rows.

    ``marks`` is a stored table with (doc_id, fingerprint). Rows with equal fingerprints are one
    node, named by their smallest id, so copies are never compared with each other.
    """
    values = saved(marks.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "fingerprints")
    linked = with_components(near_links(values, radius))
    found = values.join(linked, "node", "left")
    return found.filter("component is not null or n > 1").select("fingerprint", F.coalesce("component", "node").alias("component_id"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, fingerprint, component_id).

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; the component is the
    smallest id that can be reached. Null and empty texts have fingerprint zero and link like
    others. Rows with a null id link with nothing and have a null component. Other columns are
    ignored; an empty table gives no rows.
    """
    marks = saved(fingerprints(docs, shingle, doc_id, text), "simhash")
    rows = marks.join(near_groups(marks, radius), "fingerprint", "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), linked.alias("component_id"), "row"
    ).drop("row")


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of every text in ascending order, and the bounds of each text."""
    hashes, bounds = _hashes(pc.ascii_lower(texts), shingle)
    own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.cumsum([0, *map(len, own)])


def _wide(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts x WORDS) more words of the fingerprints: the majority bits of the hashes, mixed anew for every word."""
    turns = np.random.default_rng(SEED).integers(0, 1 << 63, (WORDS, 2), np.int64).astype(np.uint64)
    out = np.zeros((len(bounds) - 1, WORDS), np.uint64)
    for i, (turn, factor) in enumerate(turns):
        mixed = (hashes ^ turn) * (factor | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = _majority(mixed ^ (mixed >> np.uint64(29)), bounds)
    return out


def _bands(wide: np.ndarray) -> np.ndarray:
    """(texts x WORDS * WORD_KEYS) keys: disjoint runs of KEY_BITS bits of the fingerprints."""
    shifts = np.arange(WORD_KEYS, dtype=np.uint64) * np.uint64(KEY_BITS)
    keys = (wide[:, :, None] >> shifts) & np.uint64((1 << KEY_BITS) - 1)
    return keys.reshape(len(wide), -1).astype(np.int16)


def set_marks(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, file, place, digest, size, fingerprint, second, bands) of the shingle set of every row (doc_id, row, file,
    place, text): ``second`` is the second word of the fingerprint, ``bands`` are keys from its further bits."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("row", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("fingerprint", pa.int64()),
        ("second", pa.int64()), ("bands", pa.list_(pa.int16())),
    ])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_array(batch.column(4))
            for begin, end in words.steps(texts, STEP_BYTES):
                hashes, bounds = shingle_sets(texts.slice(begin, end - begin), shingle)
                digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                wide = _wide(hashes, bounds)
                keys = _bands(wide)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(begin, end - begin) for i in range(4)], pa.array(digests, pa.binary()),
                    pa.array(np.diff(bounds)), pa.array(_majority(hashes, bounds).view(np.int64)),
                    pa.array(np.ascontiguousarray(wide[:, 0]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, WORDS * WORD_KEYS), pa.int32()), pa.array(keys.ravel())),
                ], schema=schema)

    kinds = "doc_id long, row long, file string, place long, digest binary, size long, fingerprint long, second long, bands array<smallint>"
    return rows.select("doc_id", "row", "file", "place", text_or_empty().alias("text")).mapInArrow(freeing(marked), kinds)


#: Columns of the rows of a shard's piece or two.
Rows = dict[str, np.ndarray]


def _marks(rows: Rows) -> np.ndarray:
    """(2 x rows) the two words of the fingerprints."""
    return np.stack([rows["fingerprint"], rows["second"]]).view(np.uint64)


def _nearest(rows: Rows, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of nodes in one piece or two: for every node the nearest one before it whose
    fingerprint and size allow the similarity; and (a, a) for every node that is allowed for one behind it."""
    size, node = rows["size"], rows["node"]
    told = np.zeros(len(node), bool)
    for own, before, fits, distance in _fitting(_marks(rows), size, node, rows["side"], radius, similarity):
        # of equally near ones the last, so that copies make a chain and no star
        at = fits.shape[1] - 1 - np.where(fits, distance, 255)[:, ::-1].argmin(axis=1)
        i = np.flatnonzero(fits[np.arange(len(own)), at])
        yield node[own[i]], node[before[at[i]]]
        fresh = before[fits.any(axis=0)]
        fresh = fresh[~told[fresh]]
        told[fresh] = True
        yield node[fresh], node[fresh]


def _fitting(marks: np.ndarray, size: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, similarity: float):
    """Blocks (own, before, fits, distance) of rows and the rows before them, or of rows of side 1 and
    those of side 0: which pairs of different groups the fingerprints and sizes allow."""
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1) if side.any() else first
    marks, further = marks
    for begin in range(0, len(second) if len(first) else 0, SCAN_ROWS):
        own = second[begin:begin + SCAN_ROWS]
        before = first if side.any() else first[:begin + len(own)]
        distance = np.bitwise_count(marks[own][:, None] ^ marks[before])
        fits = distance <= radius
        if not side.any():
            fits &= before < own[:, None]
        # few pairs of unlike texts come this far: the rest is asked of those alone
        i, j = np.nonzero(fits)
        a, b = own[i], before[j]
        wide = distance[i, j] + np.bitwise_count(further[a] ^ further[b])
        like = (wide <= DEDUP_WIDE_RADIUS) & (group[a] != group[b])
        like &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
        fits[i, j] = like
        yield own, before, fits, distance


def _unmet(fits: np.ndarray, own: np.ndarray, before: np.ndarray, bands: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """Every row of a block with the rows that fit it and share none of its earlier bands, where they have met."""
    for at in np.flatnonzero(fits.any(axis=1)).tolist():
        i, others = own[at], before[np.flatnonzero(fits[at])]
        if bands is not None:
            others = others[~(bands[others] == bands[i]).any(axis=1)]
        if len(others):
            yield i, others


def _earlier(rows: Rows) -> np.ndarray | None:
    return np.stack(rows["bands"]) if rows["table"][0] else None


def _contested(rows: Rows, radius: int, similarity: float) -> np.ndarray:
    """Which rows of one piece or two fit a node of another group that they have not met before."""
    hit, bands = np.zeros(len(rows["node"]), bool), _earlier(rows)
    for own, before, fits, _ in _fitting(_marks(rows), rows["size"], rows["group"], rows["side"], radius, similarity):
        for i, others in _unmet(fits, own, before, bands):
            hit[i] = True
            hit[others] = True
    return hit


def _similar(rows: Rows, radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (a, b) of similar nodes that join two groups or sets of them, of one shard's piece or two.

    Every pair that fits is checked on its shingle sets where it is found, unless it meets in an earlier
    band too, where it has been checked, or a link has joined its groups already.
    """
    node, size = rows["node"], rows["size"]
    names, group = np.unique(rows["group"], return_inverse=True)
    sets = [np.frombuffer(b, np.uint64) for b in rows["own"]]
    bands, forest = _earlier(rows), Forest(len(names))
    for own, before, fits, _ in _fitting(_marks(rows), size, group, rows["side"], radius, similarity):
        for i, others in _unmet(fits, own, before, bands):
            for j in others.tolist():
                if forest.root(group[i]) != forest.root(group[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    total = len(sets[i]) + len(sets[j]) - both
                    if both >= similarity * total:
                        forest.join(group[i], group[j])
                        yield int(node[i]), int(node[j])


_SHARD = ["table", "key", "low", "high"]


def _by_shard(frames: Iterator[pd.DataFrame], work) -> Iterator:
    """``work`` on the rows of each shard's piece or pair of pieces, which come one after the other."""
    def close(rows: pd.DataFrame) -> Iterator:
        keys = rows[_SHARD].to_numpy()
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
            if b - a > 1:
                yield from work({c: values[a:b] for c, values in columns.items()})

    rest = None
    for frame in frames:
        rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(rows):
            continue
        same = (rows[_SHARD] == rows[_SHARD].iloc[-1]).all(axis=1).to_numpy()
        last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = rows.iloc[last:]
        if last:
            yield from close(rows.iloc[:last])
    if rest is not None:
        yield from close(rest)


def _packed(parts: Iterator[tuple[np.ndarray, ...]], names: list[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    """The columns of many small parts as frames of about ``most`` rows."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= most:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)), strict=True)))
            held, n = [], 0
    if held:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)), strict=True)))


def keyed_nodes(nodes: DataFrame, earlier: bool = False) -> DataFrame:
    """The nodes of a stored table (node, size, fingerprint, second, bands, group) once for each of their bands.

    A pair is looked at in the first band it shares: with ``earlier``, the bands before come along.
    """
    keyed = nodes.select("node", "size", "fingerprint", "second", "group", *(["bands"] if earlier else []), F.posexplode("bands").alias("table", "key"))
    return keyed.withColumn("bands", F.slice("bands", F.lit(1), F.col("table"))) if earlier else keyed


def shards(keyed: DataFrame, piece: int = TREE_NODES, sets: bool = False) -> DataFrame:
    """The rows of ``keyed_nodes`` in every shard that holds several groups.

    A shard is the nodes of one band key; like those of ``near_links`` it is sent to one task, or in
    pieces of ``piece`` nodes of which every two meet. With ``sets`` pieces are cut by PIECE_BYTES of shingle
    sets as well. What is told of a shard goes to all tasks: there are at most as many as keys, 163,840, and Spark
    might send the nodes instead, which it takes for as few as before they were repeated for their bands.
    """
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("group").alias("least"), F.max("group").alias("most"))
    pieces = F.ceil(F.greatest(F.col("n") / piece, F.col("bytes") * 8 / PIECE_BYTES) if sets else F.col("n") / piece).cast("int")
    several = sizes.filter("least < most").select("table", "key", pieces.alias("pieces"))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    dealt = keyed.join(F.broadcast(several), ["table", "key"]).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")
    return dealt.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side, *keyed.columns)


def _spread(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "side", "fingerprint", "node")


def nearest_pairs(nodes: DataFrame, radius: int, similarity: float, piece: int = TREE_NODES) -> DataFrame:
    """Pairs (a, b): every node with its nearest one of each shard, and (a, a) for all that can have a pair, see ``_nearest``."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = _by_shard(frames, lambda rows: _nearest(rows, radius, similarity))
        yield from _packed(((np.minimum(a, b), np.maximum(a, b)) for a, b in pairs), ["a", "b"])

    return _spread(shards(keyed_nodes(nodes), piece)).mapInPandas(freeing(search), "a long, b long").distinct()


def contested_rows(nodes: DataFrame, radius: int, similarity: float, piece: int) -> DataFrame:
    """(table, key, node) of nodes in the shards where they first meet a node of another group that they fit."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: Rows) -> Iterator[tuple[np.ndarray, ...]]:
            hit = _contested(rows, radius, similarity)
            yield rows["table"][hit], rows["key"][hit], rows["node"][hit]

        yield from _packed(_by_shard(frames, found), ["table", "key", "node"])

    return _spread(shards(keyed_nodes(nodes, earlier=True), piece)).mapInPandas(freeing(search), "table int, key smallint, node long").distinct()


def joining_links(nodes: DataFrame, sets: DataFrame, radius: int, similarity: float, piece: int = TREE_NODES) -> DataFrame:
    """Links (a, b) of similar nodes that join groups, from the shards that hold several; ``sets`` is a
    stored table (node, own) of shingle sets, which go only to the shards where a node has a pair to be
    checked. At most a link for each node and band comes out."""
    contested = saved(contested_rows(nodes, radius, similarity, piece), "contested")
    keyed = keyed_nodes(nodes, earlier=True).join(sized(contested), ["table", "key", "node"], "left_semi")
    dealt = shards(keyed, piece, sets=True).join(sets, "node")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for link in _by_shard(frames, lambda rows: _similar(rows, radius, similarity)):
            found.append(link)
            if len(found) == 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _spread(dealt).mapInPandas(freeing(search), "a long, b long")


def shingle_table(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, own) of rows (node, text): the shingle set as bytes of ascending 64-bit hashes."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_array(batch.column(1))
            for begin, end in words.steps(texts, STEP_BYTES):
                hashes, bounds = shingle_sets(texts.slice(begin, end - begin), shingle)
                own = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(own, pa.binary())], names=["node", "own"])

    return rows.select("node", text_or_empty().alias("text")).mapInArrow(freeing(sets), "node long, own binary")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, own) have the Jaccard similarity."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("own").alias("right")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "left", "right").mapInArrow(freeing(check), "a long, b long")


def similar_groups(nodes: DataFrame, texts, radius: int, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of all nodes that a chain of similar pairs links with another.

    First every node is checked with its nearest one of each shard, which settles most groups by
    about one pair a node. Shards that still hold several groups are then searched with the shingle sets at
    hand, so pairs that fail are looked at in their task and go nowhere. ``texts`` gives (node, text) of
    a table of nodes.
    """
    pairs = saved(nearest_pairs(nodes.withColumn("group", F.col("node")), radius, similarity), "nearest")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = saved(shingle_table(texts(used), shingle), "sets")
    links = saved(similar_pairs(sized(pairs).filter("a <> b"), sets, similarity), "links")
    grouped = saved(nodes.join(with_components(links), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "grouped")
    # nodes that are in no pair are allowed for no other in any of their shards
    more = joining_links(grouped.join(used, "node", "left_semi"), sets, radius, similarity)
    return with_components(links.unionByName(more))


def deduplicate(docs: DataFrame, radius: int = DEDUP_RADIUS, doc_id: str = "doc_id", text: str = "text",
                shingle: int = DEDUP_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (of rows
    that repeat it, one); rows with a null id all stay. All columns are kept whatever their names.

    Rows are linked if the Jaccard similarity of their sets of ``shingle`` words is ``similarity``
    or more: rows with equal sets are one node, nodes whose SimHash fingerprints agree in a band of bits and
    are within ``radius`` are candidates, and candidates are checked on their shingle sets. The names of the rows to drop
    are stored; the documents are not copied.
    """
    rows = named_rows(docs)
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        fields = rows.select(F.col(f"doc.`{doc_id}`").cast("long").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"), "file", "place")
        marks = saved(set_marks(fields.filter("doc_id is not null").withColumn("row", F.monotonically_increasing_id()), shingle), "simhash")
        nodes = saved(marks.groupBy("digest").agg(F.min(F.struct("row", "size", "fingerprint", "second", "bands")).alias("m"), F.count("*").alias("n")).select(
            "digest", "n", F.col("m.row").alias("node"), "m.size", "m.fingerprint", "m.second", "m.bands"), "nodes")

        def texts(used: DataFrame) -> DataFrame:
            places = saved(marks.select(F.col("row").alias("node"), "file", "place").join(used, "node", "left_semi"), "places")
            return fields.join(sized(places), ["file", "place"]).select("node", "text")

        linked = similar_groups(nodes.drop("digest", "n"), texts, radius, shingle, similarity)
        found = nodes.select("digest", "n", "node").join(linked, "node", "left")
        near = marks.select("doc_id", "row", "file", "place", "digest").join(
            found.filter("component is not null or n > 1").select("digest", F.coalesce("component", "node").alias("component_id")), "digest")
        near = saved(near.drop("digest"), "members")
        stays = near.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).getField("row").alias("first"))
        dropped = saved(sized(near).join(stays, "component_id").filter("row <> first").select("file", "place"), "dropped", stays=True)
    return rows.join(sized(dropped), ["file", "place"], "left_anti").select("doc.*")
