"""The most correlated partners of every product, for any number of products.

The Gram matrix of the products' unit vectors is computed in tiles, a pair of blocks to a task,
and only the best partners leave a tile: P x k rows instead of P x P. Blocks are ranges along the
vectors' main direction; a pair of blocks is skipped when the bound on its products, from the
blocks' centres and radii, is below what their products have found inside their own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators.portfolio import _centered, aligned_returns
from gavelwork.session import scratch_path

#: Products of a block; a task holds two blocks and their product, a strip of STRIP rows at a time.
BLOCK, STRIP = 1_024, 512
#: Blocks grow with the products up to MOST of them, so that up to MOST * COUNT products each vector goes to COUNT tasks.
COUNT, MOST = 64, 8_192
#: Bounds this close to a value do not rule it out.
SLACK = 1e-9
_MATCH = "own int, member string, partner string, value double"


def unit_vectors(series: DataFrame, key: str = "product_id") -> DataFrame:
    """(member, v): centred returns of length 1 over the aligned positions. Products without
    spread have none. A vector has as many numbers as the shortest series."""
    z = _centered(aligned_returns(series, key), key).filter(F.col("z").isNotNull())
    cells = F.sort_array(F.collect_list(F.struct("position", "z")))
    return z.groupBy(F.col(key).cast("string").alias("member")).agg(cells.getField("z").alias("v"))


def main_direction(vectors: DataFrame) -> list[float]:
    """The direction of most spread, from per-task sums of products (numbers: length squared)."""
    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"row": range(len(total)), "g": list(total)})

    cells = vectors.select("v").mapInPandas(gram, "row int, g array<double>").select("row", F.posexplode("g").alias("col", "x"))
    sums = cells.groupBy("row", "col").agg(F.sum("x").alias("x")).collect()
    size = max(r["row"] for r in sums) + 1
    whole = np.zeros((size, size))
    for r in sums:
        whole[r["row"], r["col"]] = r["x"]
    return np.linalg.eigh(whole)[1][:, -1].tolist()


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def block_size(n: int, block: int) -> int:
    """Products of a block: ``block``, or more where that would give over COUNT blocks."""
    return max(block, min(MOST, -(-n // COUNT)))


def blocks(vectors: DataFrame, n: int, block: int) -> tuple[DataFrame, int]:
    """The stored vectors with ``own``, a block of about ``block`` of them, and the number of blocks.

    A little of the member's hash is added to the place along the direction, so that equal vectors,
    however many, are dealt to several blocks too.
    """
    count = -(-n // block)
    hashed = F.pmod(F.xxhash64("member"), F.lit(1 << 20)).cast("double") / (1 << 20) * 1e-6
    placed = vectors.withColumn("place", _dot(F.col("v"), F.array(*map(F.lit, main_direction(vectors)))) + hashed)
    if count == 1:
        return placed.withColumn("own", F.lit(0)), 1
    cuts = placed.agg(F.percentile_approx("place", [i / count for i in range(1, count)], 100 * count).alias("c")).first()["c"]
    own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("place")))
    return placed.withColumn("own", own), count


def _best(products: np.ndarray, members: np.ndarray, partners: np.ndarray, k: int, floor: np.ndarray) -> pd.DataFrame:
    """The k best partners of each row at its floor or above; partners are in the order of their names, which settles ties.
    Values that differ in the rounding of a product alone, as those of equal vectors do, are ties."""
    row, at = np.nonzero(products >= floor[:, None] - SLACK)
    values = np.round(products[row, at], 12)
    order = np.lexsort((at, -values, row))
    row, at, values = row[order], at[order], values[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"member": members[row[keep]], "partner": partners[at[keep]], "value": values[keep]})


def _inside(k: int):
    """Best partners within a block, and a row (center, radius, floor) about the block: all its
    products have k partners at ``floor`` or above."""
    def inside(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("member", kind="stable")
        x, names = np.stack(frame["v"].to_numpy()), frame["member"].to_numpy()
        parts, floor = [], np.inf if len(x) > k else -2.0
        for begin in range(0, len(x), STRIP):
            products = x[begin:begin + STRIP] @ x.T
            own = np.arange(len(products))
            products[own, begin + own] = -np.inf
            least = np.partition(products, -k, axis=1)[:, -k] if len(x) > k else np.full(len(products), -2.0)
            floor = min(floor, least.min())
            parts.append(_best(products, names[begin:begin + STRIP], names, k, least))
        center = x.mean(axis=0)
        about = pd.DataFrame({"center": [center], "radius": [np.sqrt(((x - center) ** 2).sum(axis=1).max())], "floor": [floor]})
        both = pd.concat([*[p.assign(center=None) for p in parts], about], ignore_index=True).assign(own=key[0])
        return both.reindex(columns=["own", "member", "partner", "value", "center", "radius", "floor"])

    return inside


def _across(k: int):
    """Best partners of two blocks in one another, of pairs at or above what a product has found in its own block."""
    def across(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("member", kind="stable")
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        parts = [pd.DataFrame({"member": [], "partner": [], "value": []})]
        for one, other in ((left, right), (right, left)) if len(left) and len(right) else ():
            x, y = np.stack(one["v"].to_numpy()), np.stack(other["v"].to_numpy())
            names, partners, floor = one["member"].to_numpy(), other["member"].to_numpy(), one["floor"].to_numpy()
            for begin in range(0, len(x), STRIP):
                part = slice(begin, begin + STRIP)
                parts.append(_best(x[part] @ y.T, names[part], partners, k, floor[part]))
        return pd.concat(parts, ignore_index=True).assign(own=key[0])[["own", "member", "partner", "value"]]

    return across


def open_pairs(about: DataFrame, count: int) -> DataFrame:
    """(low, high) of the pairs of blocks whose products may reach the floor of either."""
    sides = about.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).filter("other <> own")
    low = sides.filter("own < other").select(F.col("own").alias("low"), F.col("other").alias("high"), F.struct("center", "radius", "floor").alias("a"))
    high = sides.filter("own > other").select(F.col("other").alias("low"), F.col("own").alias("high"), F.struct("center", "radius", "floor").alias("b"))
    a, b = F.col("a.center"), F.col("b.center")
    bound = _dot(a, b) + F.col("a.radius") * _norm(b) + F.col("b.radius") * _norm(a) + F.col("a.radius") * F.col("b.radius")
    met = low.join(high, ["low", "high"])
    return met.filter(bound >= F.least("a.floor", "b.floor") - SLACK).select("low", "high")


def closest_partners(series: DataFrame, k: int = 5, key: str = "product_id", block: int = BLOCK) -> DataFrame:
    """(member, position, partner, correlation): the k partners of every product with the highest
    correlation of returns, ties by name; the numbers are those of ``portfolio.correlation_pairs``.

    Products with fewer than two points or without spread have no partners and are none.
    """
    spark = series.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    vectors = kept(unit_vectors(series, key), "vectors")
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], "member string, position int, partner string, correlation double")
    dealt, count = blocks(vectors, n, block_size(n, block))
    dealt = kept(dealt.select("own", "member", "v"), "blocks")
    inside = kept(dealt.groupBy("own").applyInPandas(_inside(k), f"{_MATCH}, center array<double>, radius double, floor double"), "inside")
    found = inside.filter("member is not null").select("own", "member", "partner", "value")
    if count > 1:
        pairs = kept(open_pairs(inside.filter("member is null").select("own", "center", "radius", "floor"), count), "pairs")
        # a product that has found k partners in its own block needs none below the last of them
        floors = found.groupBy("member").agg(F.when(F.count("*") >= k, F.min("value")).otherwise(-2.0).alias("floor"))
        own = dealt.join(floors, "member", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        tiles = own.join(pairs.select("low", "high", F.col("low").alias("own"), F.lit(0).alias("side")).unionByName(
            pairs.select("low", "high", F.col("high").alias("own"), F.lit(1).alias("side"))), "own")
        found = found.unionByName(tiles.groupBy("low", "high").applyInPandas(_across(k), _MATCH))
    order = Window.partitionBy("member").orderBy(F.col("value").desc(), "partner")
    ranked = found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return ranked.select("member", "position", "partner", half_up(F.col("value"), 4).alias("correlation"))
