"""Correlation and diversification of a set of return series.

The correlation matrix has one cell per pair of members, so its size is the caller's
choice of members. It is computed as a sum of per-partition Gram matrices: the pairs are
never rows of a join. The mean correlation needs no pairs at all and works for any number
of products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators.metrics import ANNUAL, with_returns


def aligned_returns(series: DataFrame, key: str = "product_id") -> DataFrame:
    """The newest *k* returns of every product, *k* being the shortest series length.

    Products with a single point have no returns and do not count.
    """
    points = with_returns(series, key).filter(F.col("n") > 1).select(key, "returns", "back", "n")
    shortest = points.agg(F.min("n").alias("k")).scalar()
    return points.filter(F.col("back") <= shortest).select(
        key, F.col("back").alias("position"), "returns"
    )


def _centered(aligned: DataFrame, key: str) -> DataFrame:
    """Returns minus their mean, over the root of their sum of squares (NULL when flat)."""
    whole = Window.partitionBy(key)
    shifted = aligned.withColumn("_d", F.col("returns") - F.avg("returns").over(whole))
    return shifted.withColumn(
        "z", F.try_divide(F.col("_d"), F.sqrt(F.sum(F.col("_d") * F.col("_d")).over(whole)))
    )


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of the outer products of the rows' vectors, upper triangle, one per partition."""
    sums, names = None, None
    for batch in batches:
        if len(batch):
            block = np.stack(batch["z"].to_numpy())
            names = batch["members"].iloc[0]
            sums = block.T @ block if sums is None else sums + block.T @ block
    if sums is not None:
        i, j = np.triu_indices(len(names), k=1)
        yield pd.DataFrame({"name_a": names[i], "name_b": names[j], "part": sums[i, j]})


def correlation_pairs(series: DataFrame, key: str = "product_id") -> DataFrame:
    """Correlation of every pair of members (``name_a`` before ``name_b``).

    The vector of one position holds one value per member, in member order, so it is as
    long as the member list; restrict the series to the wanted members first.
    """
    z = _centered(aligned_returns(series, key), key).filter(F.col("z").isNotNull())
    member = F.col(key).cast("string").alias("member")
    rows = z.groupBy("position").agg(F.sort_array(F.collect_list(F.struct(member, "z"))).alias("cells"))
    return (
        rows.select(F.col("cells.member").alias("members"), F.col("cells.z").alias("z"))
        .mapInPandas(_gram, "name_a string, name_b string, part double")
        .groupBy("name_a", "name_b")
        .agg(half_up(F.sum("part"), 4).alias("correlation"))
    )


def portfolio_metrics(series: DataFrame, key: str = "product_id") -> DataFrame:
    """Mean correlation, volatility of the equal-weight portfolio, diversification ratio.

    The mean over all pairs follows from unit vectors z: the sum over pairs of z_a.z_b is
    (|sum z|^2 - members) / 2, so the work is linear in the number of products.
    """
    z = _centered(aligned_returns(series, key), key)
    per_position = z.groupBy("position").agg(
        F.avg("returns").alias("mean_return"),
        F.sum("z").alias("sum_z"),
        F.count("z").alias("members"),
        F.count("*").alias("products"),
    )
    raw = per_position.agg(
        F.sum(F.col("sum_z") * F.col("sum_z")).alias("_square"),
        F.max("members").alias("_m"),
        F.max("products").alias("products_count"),
        F.stddev_pop("mean_return").alias("_std"),
        F.count("*").alias("aligned_points"),
    )
    pairs = F.col("_m") * (F.col("_m") - 1) / 2
    mean = F.try_divide((F.col("_square") - F.col("_m")) / 2, pairs)
    return raw.filter(F.col("products_count") >= 2).select(
        half_up(mean, 3).alias("avg_correlation"),
        half_up(F.col("_std") * ANNUAL * 100, 2).alias("portfolio_volatility"),
        half_up(1 - mean, 3).alias("diversification_ratio"),
        "products_count",
        "aligned_points",
    )


def max_correlation(pairs: DataFrame) -> DataFrame:
    """Largest pair correlation of :func:`correlation_pairs`."""
    return pairs.agg(F.max("correlation").alias("max_correlation"))
