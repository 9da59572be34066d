"""Near-duplicate vectors by cosine: PCA-ordered tiles that stop when the cosine can't be reached."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelwork.llm.common import saved, with_components

THRESHOLD = 0.95
#: Vectors of a block; a task compares two blocks.
BLOCK = 8_192
#: Vectors of a tile, and the dimensions after which a tile is looked at again.
TILE, STAGES = 1_024, (4, 8, 16, 32, 64, 128, 256, 512, 1_024)
#: Products this close to the threshold are computed anew from the vectors as they were given.
SLACK = 1e-9
#: Below this part of pairs that are left, the pairs are followed one by one.
SPARSE = 0.02


def directions(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(node, dims, unit, n) for every different direction that can link: the unit vector as
    doubles, its smallest id and the number of rows. Rows whose vector or id is null, whose
    vector is zero or holds a null or a number that is not finite are left out."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("node"), values.alias("v")).filter("node is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(fine & F.exists("v", lambda x: x != 0))
    # equal vectors first meet as they are, whatever many there are
    return rows.groupBy("v").agg(F.min("node").alias("node"), F.count("*").alias("n"))


def _rotation(rows: DataFrame) -> dict[int, np.ndarray]:
    """Principal directions for each number of dimensions, from sums of products of unit vectors."""
    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for dims, part in frame.groupby(frame["v"].map(len)):
                x = _unit(np.stack(part["v"].to_numpy()))
                total[dims] = total.get(dims, 0) + x.T @ x
        for dims, g in total.items():
            yield pd.DataFrame({"dims": [dims] * dims, "row": range(dims), "g": list(g)})

    parts = rows.select("v").mapInPandas(gram, "dims int, row int, g array<double>")
    at = parts.select("dims", "row", F.posexplode("g").alias("col", "x")).groupBy("dims", "row", "col").agg(F.sum("x").alias("x"))
    whole = at.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("row", "col", "x"))).alias("g")).collect()  # dims squared numbers
    out = {}
    for row in whole:
        g = np.array([e["x"] for e in row["g"]]).reshape(row["dims"], row["dims"])
        out[row["dims"]] = np.linalg.eigh((g + g.T) / 2)[1][:, ::-1]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tile_pairs(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose product may reach the threshold, and their products.

    ``x`` and ``y`` are rotated unit vectors, ``tx`` and ``ty`` their suffix norms at the stages. After each
    stage the rest of a product is at most the product of the suffix norms; pairs that can't
    reach the threshold are gone, and the tile ends when none is left.
    """
    dims = x.shape[1]
    cuts = [s for s in STAGES if s < dims] + [dims]
    done, product = 0, np.zeros((len(x), len(y)))
    for k, cut in enumerate(cuts):
        product += x[:, done:cut] @ y[:, done:cut].T
        done = cut
        alive = product >= threshold - SLACK - np.outer(tx[:, k], ty[:, k])
        left = np.count_nonzero(alive)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left < SPARSE * alive.size or cut == dims:
            break
    i, j = np.nonzero(alive)
    value = product[i, j]
    while done < dims:
        k += 1
        cut = cuts[k]
        value = value + np.einsum("ij,ij->i", x[i, done:cut], y[j, done:cut])
        keep = value >= threshold - SLACK - tx[i, k] * ty[j, k]
        i, j, value, done = i[keep], j[keep], value[keep], cut
    return i, j, value


def suffix_norms(x: np.ndarray) -> np.ndarray:
    dims = x.shape[1]
    cuts = [s for s in STAGES if s < dims] + [dims]
    rest = np.concatenate([np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
    return np.sqrt(rest[:, cuts])


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among (i, j) that join two sets; ``label`` has the smallest row of each row's set.

    In rounds, every set with a link to a smaller one hangs itself below the smallest of them.
    """
    out_i, out_j = [], []
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        open_ = low < high
        if not open_.any():
            return np.concatenate([*out_i, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*out_j, np.zeros(0, np.int64)]).astype(np.int64)
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        out_i.append(i[first])
        out_j.append(j[first])
        below = np.arange(len(label))
        below[high[first]] = low[first]
        while (below[below] != below).any():
            below = below[below]
        label[:] = below[label]


def compare(x: np.ndarray, y: np.ndarray | None, rotation: np.ndarray, nodes_x, sizes_x, nodes_y, sizes_y, threshold: float):
    """Links of two blocks (or of one with itself): rows linked to each row, and links (a, b)
    that span the components. Pairs are counted where they are found and not kept."""
    own = y is None
    rx = x @ rotation
    ry = rx if own else y @ rotation
    tx = suffix_norms(rx)
    ty = tx if own else suffix_norms(ry)
    if own:
        y, nodes_y, sizes_y = x, nodes_x, sizes_x
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    label, spanning = np.arange(len(x) + (0 if own else len(y))), []
    shift = 0 if own else len(x)
    for a in range(0, len(x), TILE):
        for b in range(a if own else 0, len(y), TILE):
            i, j, value = tile_pairs(rx[a:a + TILE], ry[b:b + TILE], tx[a:a + TILE], ty[b:b + TILE], threshold)
            i, j = i + a, j + b
            if own:
                i, j, value = i[i < j], j[i < j], value[i < j]
            near = np.abs(value - threshold) <= SLACK
            if near.any():
                value[near] = np.einsum("ij,ij->i", x[i[near]], y[j[near]])
            i, j = i[value >= threshold], j[value >= threshold]
            np.add.at(count_x, i, sizes_y[j])
            np.add.at(count_x if own else count_y, j, sizes_x[i])
            p, q = hook(label, i, j + shift)
            spanning += zip(nodes_x[p].tolist(), nodes_y[q - shift].tolist(), strict=True)
    return count_x, count_y, spanning


def links(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """From a stored table of directions: rows (node, linked, a, b), where linked rows of a node
    add up and (a, b) span the components.

    Vectors of one number of dimensions are dealt by hash into blocks of about ``block`` and every
    two blocks meet in one task, so a task holds two blocks however many vectors are alike.
    """
    rotation = _rotation(rows)
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(rotation)  # dims squared numbers
    sized = rows.withColumn("dims", F.size("v"))
    counts = {r["dims"]: r["n"] for r in sized.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    blocks = {d: -(-n // block) for d, n in counts.items()}
    if not blocks:
        return spark.createDataFrame([], "node long, linked long, a long, b long")
    per = F.create_map(*[F.lit(v) for d, n in blocks.items() for v in (d, n)])[F.col("dims")]
    own = F.pmod(F.xxhash64("node"), per).cast("int")
    met = sized.withColumns({"own": own, "per": per}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("per") - 1))).select(
        "dims", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "v"
    )
    tasks = sum(n * (n + 1) // 2 for n in blocks.values())

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dims, low, high = key
        frame = frame.sort_values("node", kind="stable")
        first = frame[frame["own"] == low]
        second = frame[frame["own"] == high] if low != high else None
        x = _unit(np.stack(first["v"].to_numpy())) if len(first) else np.zeros((0, dims))
        y = None if second is None else _unit(np.stack(second["v"].to_numpy())) if len(second) else np.zeros((0, dims))
        nx, sx = first["node"].to_numpy(), first["n"].to_numpy()
        ny, sy = (nx, sx) if second is None else (second["node"].to_numpy(), second["n"].to_numpy())
        cx, cy, span = compare(x, y, held.value[dims], nx, sx, ny, sy, threshold)
        parts = [pd.DataFrame({"node": nx[cx > 0], "linked": cx[cx > 0]})]
        if second is not None:
            parts.append(pd.DataFrame({"node": ny[cy > 0], "linked": cy[cy > 0]}))
        parts.append(pd.DataFrame(span, columns=["a", "b"]))
        return pd.concat(parts).reindex(columns=["node", "linked", "a", "b"]).astype("Int64")

    return met.repartition(tasks, "dims", "low", "high").groupBy("dims", "low", "high").applyInPandas(one, "node long, linked long, a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding",
                 block: int = BLOCK) -> DataFrame:
    """Every row of ``vectors`` as (vec_id, n_links, component_id, kept).

    Rows link when the cosine of their vectors is at least ``threshold``; ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest id reached. Vectors that can't link
    (see ``directions``), and vectors of another number of dimensions, link with nothing. A row
    with a null id has a null component and is kept. Other columns are ignored; an empty table
    gives no rows.
    """
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    rows = saved(directions(vectors, id_column, vector), "directions")
    found = saved(links(rows, threshold, block), "links")
    linked = found.filter("node is not null").groupBy("node").agg(F.sum("linked").alias("linked"))
    components = with_components(found.filter("a is not null").select("a", "b"))
    known = rows.join(linked, "node", "left").join(components, "node", "left").select(
        "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    ).filter("n_links > 0")
    out = given.join(known, "v", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
