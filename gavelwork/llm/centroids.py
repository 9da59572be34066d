"""Centroid clustering of integer vectors by a progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.llm.common import saved

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Coefficients after which centroids are looked at again, coarse to fine.
CUTS = (4, 8, 16, 32, DIMS)
#: Vectors that are compared in one step.
STEP = 4_096
#: Components below this keep every sum of the search within 64 bits; others are computed in exact Python numbers.
NARROW = 1 << 20
#: Sums travel in digits of so many bits, so that they are exact whatever their size.
DIGIT = 40


def walsh(x: np.ndarray) -> np.ndarray:
    """Exact Walsh-Hadamard transform of the rows, coefficients by the number of sign changes of
    their basis row, so that the first ones hold the coarse shape. Its own inverse times DIMS."""
    out, half = x.copy(), 1
    while half < x.shape[1]:
        pairs = out.reshape(len(x), x.shape[1] // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(x.shape)
        half *= 2
    return out[:, _sequency(x.shape[1])]


def unwalsh(z: np.ndarray) -> np.ndarray:
    """The rows whose transform is ``z``."""
    natural = np.empty_like(z)
    natural[:, _sequency(z.shape[1])] = z
    inverse = np.argsort(_sequency(z.shape[1]))
    return walsh(natural)[:, inverse] // z.shape[1]


def _sequency(n: int) -> np.ndarray:
    index = np.arange(n)
    rows = 1 - 2 * (np.bitwise_count(index[:, None] & index).astype(np.int64) & 1)
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def nearest(z: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row and the squared distance, from transforms.

    Squared differences of coefficients are added up coarse to fine; a sum over some of them is a
    lower bound. The centroid that leads after the first ones is finished, and those whose bound is above
    its distance are out. All that are left are finished, so ties go to the smaller number.
    """
    def part(i, j, begin, end):
        difference = z[i, begin:end] - centers[j, begin:end]
        return (difference * difference).sum(axis=1)

    every = np.arange(len(z))
    bound = np.stack([part(every, np.full(len(z), j), 0, CUTS[0]) for j in range(len(centers))], axis=1)
    lead = bound.argmin(axis=1)
    best = bound[every, lead] + part(every, lead, CUTS[0], z.shape[1])
    i, j = np.nonzero(bound <= best[:, None])
    for begin, end in zip(CUTS, CUTS[1:], strict=False):
        bound[i, j] += part(i, j, begin, end)
        left = bound[i, j] <= best[i]
        i, j = i[left], j[left]
    final = np.full(bound.shape, best.max(initial=0) + 1, dtype=z.dtype)
    final[i, j] = bound[i, j]
    cluster = final.argmin(axis=1)
    return cluster, final[every, cluster] // z.shape[1]


def _integers(row) -> list[int]:
    """floor(SCALE * x) of doubles, exact where the product leaves the range of doubles too."""
    return [math.floor(SCALE * x) if abs(x) < 2.0 ** 53 else SCALE * int(x) for x in row]


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, narrow, wide) of the vectors of exactly DIMS components, none null or not finite:
    their transform as long numbers, or as decimal text where a component is beyond NARROW."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == DIMS)
    rows = rows.filter(F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    small = F.forall("x", lambda e: F.abs(e) < NARROW / SCALE)
    whole = F.transform("x", lambda e: F.floor(F.lit(float(SCALE)) * e).cast("long"))
    rows = rows.select("vec_id", F.when(small, whole).alias("narrow"), F.when(~small, F.col("x")).alias("wide"))

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            narrow = batch.column(1)
            x = np.asarray(narrow.flatten()).reshape(-1, DIMS)
            z = walsh(x)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(narrow.is_valid()))]) * DIMS
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(z.ravel(), pa.int64()), mask=narrow.is_null())
            wide = [None if row is None else [str(v) for v in walsh(np.array([_integers(row)], object))[0]] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(wide, pa.list_(pa.string()))], names=["vec_id", "narrow", "wide"])

    return rows.mapInArrow(transformed, "vec_id long, narrow array<long>, wide array<string>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and transforms of a few thousand vectors, as 64-bit or as Python numbers."""
    for batch in batches:
        is_narrow = np.asarray(batch.column(1).is_valid())
        for begin in range(0, batch.num_rows, STEP):
            part = batch.slice(begin, STEP)
            flags = is_narrow[begin:begin + STEP]
            for narrow in (True, False):
                at = np.flatnonzero(flags == narrow)
                if len(at):
                    rows = part.take(pa.array(at))
                    if narrow:
                        yield rows.column(0), np.asarray(rows.column(1).flatten()).reshape(-1, DIMS)
                    else:
                        yield rows.column(0), np.array([[int(v) for v in row] for row in rows.column(2).to_pylist()], object)


def _centers(transforms: list[list[int]], kind) -> np.ndarray:
    return np.array(transforms, kind).reshape(len(transforms), DIMS)


def _searched(z: np.ndarray, transforms: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` in 64 bits where vectors and centroids allow it, in Python numbers otherwise."""
    small = z.dtype != object and all(abs(v) <= NARROW * DIMS for row in transforms for v in row)
    kind = np.int64 if small else object
    return nearest(z.astype(kind), _centers(transforms, kind))


def start_centroids(rows: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """Transforms of the k vectors with the smallest sha256 of ``1:<vec_id>``, in that order; vectors
    without an id come last. Of fewer vectors than k, all."""
    draw = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    row = F.coalesce(F.transform("narrow", lambda v: v.cast("string")), "wide")
    first = rows.select(draw.alias("draw"), row.alias("z")).orderBy(F.col("draw").asc_nulls_last(), "z").limit(k).collect()  # k rows
    return [[int(v) for v in r["z"]] for r in first]


def _sums(rows: DataFrame, transforms: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and exact componentwise sum of the transforms of every centroid that has vectors.

    Each task adds up its own rows; sums meet in digits of DIGIT bits, at most k * DIMS keys."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, np.ndarray] = {}
        for _, z in _blocks(batches):
            cluster, _ = _searched(z, transforms)
            for c in np.unique(cluster).tolist():
                own = z[cluster == c]
                counts[c] = counts.get(c, 0) + len(own)
                totals[c] = totals.get(c, 0) + own.sum(axis=0).astype(object)
        out = []
        for c, total in totals.items():
            out.append((c, -1, 0, counts[c]))
            for dim, value in enumerate(total.tolist()):
                place, left = 0, abs(value)
                while left:
                    out.append((c, dim, place, (left & ((1 << DIGIT) - 1)) * (1 if value > 0 else -1)))
                    left, place = left >> DIGIT, place + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["cluster", "dim", "place", "value"])

    parts = rows.mapInArrow(added, "cluster long, dim long, place long, value long")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "dim", "place").agg(F.sum("value").alias("value")).collect():  # of k centroids
        count, total = found.setdefault(r["cluster"], (0, [0] * DIMS))
        if r["dim"] < 0:
            found[r["cluster"]] = (r["value"], total)
        else:
            total[r["dim"]] += r["value"] << (DIGIT * r["place"])
    return found


def _moved(transforms: list[list[int]], sums: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """Transforms of floor(sum / count) of every centroid with vectors; the others stay."""
    out = []
    for c, old in enumerate(transforms):
        if c in sums:
            count, total = sums[c]
            mean = [v // count for v in unwalsh(np.array([total], object))[0].tolist()]
            out.append([int(v) for v in walsh(np.array([mean], object))[0]])
        else:
            out.append(old)
    return out


def fit(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> list[list[int]]:
    """Transforms of the centroids after ``rounds`` rounds over a stored table of transforms."""
    transforms = start_centroids(rows, k)
    for _ in range(rounds if transforms else 0):
        transforms = _moved(transforms, _sums(rows, transforms))
    return transforms


def components(transforms: list[list[int]]) -> list[list[int]]:
    """The centroids themselves."""
    return [[int(v) for v in row] for row in unwalsh(_centers(transforms, object))] if transforms else []


def assign(rows: DataFrame, transforms: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every row; a squared distance beyond a long is null."""
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, z in _blocks(batches):
            cluster, distance = _searched(z, transforms)
            fits = [v if v < 1 << 63 else None for v in distance.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(assigned, "vec_id long, cluster int, distance long")


def text_of(values: list[list[int]], cluster: Column) -> Column:
    """The components of a cluster's centroid as decimal numbers joined by commas."""
    texts = [",".join(map(str, row)) for row in values] or [""]
    return F.get(F.array(*map(F.lit, texts)), cluster)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that is kept.

    Vectors of exactly DIMS components, none null or not finite, become integers floor(SCALE * x);
    others give no row. ``k`` centroids start from kept vectors, are moved ``rounds`` times to the
    floor of their vectors' mean, and all vectors are assigned to the nearest (ties: the smaller
    number). Repeated rows count each for itself, rows with a null id are assigned like others,
    fewer vectors than k are a centroid each at first. Distances and inertias that are beyond a
    long are null. Other columns are ignored; an empty table gives no rows.
    """
    rows = saved(integer_vectors(vectors, vec_id, embedding), "walsh")
    transforms = fit(rows, k, rounds)
    found = saved(assign(rows, transforms), "assigned")
    wide = F.col("distance").cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(wide).alias("s"), (F.count("*") > F.count("distance")).alias("beyond")).collect()  # k rows

    def total(part):
        value = sum(int(r["s"] or 0) for r in part)
        return None if any(r["beyond"] for r in part) or value >= 1 << 63 else value

    each = {r["cluster"]: total([r]) for r in sums}
    own = F.get(F.array(*[F.lit(each.get(c)).cast("long") for c in range(max(len(transforms), 1))]), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(total(sums)).cast("long").alias("inertia"),
        text_of(components(transforms), F.col("cluster")).alias("centroid"),
    )
