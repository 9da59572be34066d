"""Exact order statistics that survive a hot group.

``median`` over a group that holds a third of all rows would send every row (or one map
of values per input task) to a single task. Prices are whole cents, so instead the rows
are first counted per (group, price). That aggregate is combined on the map side and
spread over the cluster by group *and* price; what reaches the task of one group is
bounded by its number of different prices, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_histogram(rows: DataFrame, keys: Sequence[str], price: str = "price") -> DataFrame:
    """Row count per (keys, price); NULL prices are left out."""
    return (
        rows.filter(F.col(price).isNotNull())
        .groupBy(*keys, price)
        .agg(F.count("*").alias("n_rows"))
    )


def weighted_percentile(price: Column, share: float, n_rows: Column) -> Column:
    """Linear (inclusive) percentile over histogram rows."""
    return F.percentile(price.cast("double"), F.lit(share), n_rows)


def weighted_median(price: Column, n_rows: Column) -> Column:
    return weighted_percentile(price, 0.5, n_rows)


def histogram_medians(histogram: DataFrame, keys: Sequence[str], price: str = "price") -> DataFrame:
    """Median and number of rows per group, read off the running row counts.

    Sort and windows spill to disk, so the number of different prices needs no memory bound either. The row of
    the highest price stands for its group: grouping once more would hold a row for each group of a task, and a
    series has nearly as many groups as prices.
    """
    by_price, whole = Window.partitionBy(*keys).orderBy(price), Window.partitionBy(*keys)
    upto, n, total = F.col("_upto"), F.col("n_rows"), F.col("_total")
    ranked = histogram.select(
        *keys, F.col(price).cast("double").alias("_p"), "n_rows",
        F.sum("n_rows").over(by_price.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("n_rows").over(whole).alias("_total"),
    )

    def value_at(position: Column) -> Column:
        return F.max(F.when((upto >= position) & (upto - n < position), F.col("_p"))).over(whole)

    lower, upper = value_at(F.floor((total + 1) / 2)), value_at(F.floor((total + 2) / 2))
    found = ranked.select(*keys, ((lower + upper) / 2).alias("median"), total.alias("n_total"), upto)
    return found.filter(upto == F.col("n_total")).select(*keys, "median", "n_total")


def weighted_mean(price: Column, n_rows: Column) -> Column:
    """Mean over histogram rows. The sum is exact when the price is DECIMAL."""
    return F.try_divide(F.sum(price * n_rows).cast("double"), F.sum(n_rows))


def exclusive_quartiles(histogram: DataFrame, keys: Sequence[str], price: str = "price") -> DataFrame:
    """q1 and q3 per group by the exclusive method, with the median and the group size.

    Rank i(n+1)/4 of the sorted values, clamped to the first and last pair and
    interpolated between the two neighbours. Groups with fewer than two rows get NULL.
    """
    by_price = Window.partitionBy(*keys).orderBy(price)
    whole = Window.partitionBy(*keys)
    n = F.col("n_total")
    ranked = histogram.select(
        *keys,
        F.col(price).cast("double").alias("_p"),
        "n_rows",
        F.sum("n_rows").over(by_price.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("n_rows").over(whole).alias("n_total"),
    )

    def rank(i: int) -> Column:
        return F.greatest(F.lit(1), F.least(F.floor((n + 1) * i / 4), n - 1))

    def value_at(position: Column) -> Column:
        inside = (F.col("_upto") >= position) & (F.col("_upto") - F.col("n_rows") < position)
        return F.max(F.when(inside, F.col("_p")))

    found = ranked.groupBy(*keys).agg(
        F.max("n_total").alias("n_total"),
        F.min("_p").alias("min_price"),
        F.max("_p").alias("max_price"),
        value_at(rank(1)).alias("_a1"),
        value_at(rank(1) + 1).alias("_b1"),
        value_at(rank(3)).alias("_a3"),
        value_at(rank(3) + 1).alias("_b3"),
        ((value_at(F.floor((n + 1) / 2)) + value_at(F.floor((n + 2) / 2))) / 2).alias("median"),
    )

    def blend(i: int) -> Column:
        weight = (n + 1) * i - rank(i) * 4
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        return F.when(n >= 2, (low * (4 - weight) + high * weight) / 4)

    return found.select(
        *keys, "n_total", "min_price", "max_price",
        blend(1).alias("q1"), blend(3).alias("q3"), "median",
    )
