"""Counts over several levels in one aggregation, and sketches that are stored and merged for spans of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up, ratio
from gavelwork.functions.text import first_match

#: Levels of a listing summary; the empty one is the total.
LEVELS = (("condition_category",), ("search_strategy",), ("set_name",), ("condition_category", "search_strategy"), ())
#: Accuracy of sketches: a KLL sketch of size k is off by about 2.3 / k ** 0.9 of the ranks, and one with
#: 2 ** p HLL registers by 1.04 / 2 ** (p / 2) of the number (both with high probability, at 3 sigma here).
KLL_SIZE, HLL_BITS = 400, 14
RANK_ERROR = 3 * 2.296 / KLL_SIZE ** 0.9021
COUNT_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)


def level_name(names: Sequence[str]) -> Column:
    """The columns that a row is grouped by, as ``a+b``; ``total`` for none."""
    used = F.array_compact(F.array(*[F.when(F.grouping(n) == 0, F.lit(n)) for n in names]))
    return F.when(F.size(used) > 0, F.array_join(used, "+")).otherwise("total")


def level_summary(listings: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, item: str = "product_id", exact: bool = True) -> DataFrame:
    """(level, the level columns, listings, priced, avg_price, lowest, highest, items) of every group of every level.

    The exact way groups the rows once by product and all level columns, and what comes out is added up for the
    levels, so no listing is copied for each of them. ``exact=False`` takes ``items`` from an HLL sketch in one
    scan and one aggregation, which saves the exchanges by product and the rows they move.
    """
    names = list(dict.fromkeys(n for level in levels for n in level))
    sets = [[F.col(n) for n in level] for level in levels]
    if not exact:
        positive = F.when(F.col("price") > 0, F.col("price"))
        return listings.groupingSets(sets, *names).agg(
            level_name(names).alias("level"), F.count("*").alias("listings"), F.count(positive).alias("priced"), half_up(F.avg(positive), 4).alias("avg_price"),
            F.min(positive).alias("lowest"), F.max(positive).alias("highest"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(item), HLL_BITS)).alias("items"),
        )
    items = first_match([(_is_level(level, names), F.coalesce(F.sum(f"_first_{i}"), F.lit(0).cast("bigint"))) for i, level in enumerate(levels)])
    return _by_item(listings, names, levels, item).groupingSets(sets, *names).agg(
        level_name(names).alias("level"), F.sum("_listings").alias("listings"), F.sum("_priced").alias("priced"),
        half_up(ratio(F.sum("_sum"), F.sum("_priced")), 4).alias("avg_price"), F.min("_lowest").alias("lowest"), F.max("_highest").alias("highest"),
        items.alias("items"),
    )


def _by_item(listings: DataFrame, names: Sequence[str], levels: Sequence[Sequence[str]], item: str) -> DataFrame:
    """Counts, sums and ranges by the level columns, with ``_first_i``: the products counted for level i, each
    product in one row of each group of that level."""
    positive = F.when(F.col("price") > 0, F.col("price"))
    keys = list(dict.fromkeys([item, *names]))
    firsts = {}
    for i, level in enumerate(levels):
        own = list(dict.fromkeys([item, *level]))
        rest = [n for n in keys if n not in own]
        first = F.row_number().over(Window.partitionBy(*own).orderBy(*rest)) == 1 if rest else F.lit(True)
        firsts[f"_first_{i}"] = F.when(first & F.col(item).isNotNull(), F.lit(1).cast("bigint"))
    counted = listings.groupBy(*keys).agg(
        F.count("*").alias("_listings"), F.count(positive).alias("_priced"), F.sum(positive).alias("_sum"),
        F.min(positive).alias("_lowest"), F.max(positive).alias("_highest"),
    )
    # dealt by product: all orders are within products, one exchange serves them
    rows = counted.repartition(item).withColumns(firsts)
    return rows.groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in ("_listings", "_priced", "_sum", *firsts)], F.min("_lowest").alias("_lowest"), F.max("_highest").alias("_highest"),
    )


def _is_level(level: Sequence[str], names: Sequence[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & (F.grouping(n) == (0 if n in level else 1))
    return test


def day_sketches(listings: DataFrame, keys: Sequence[str], day: str = "sold_date", item: str = "product_id") -> DataFrame:
    """(keys, day, prices, items, n): what spans are answered from, a row for each day and group.

    ``prices`` is a KLL sketch of the positive prices, ``items`` an HLL sketch of the products.
    """
    rows = listings.filter(F.col("price") > 0).withColumn("day", F.to_date(day))
    return rows.groupBy(*keys, "day").agg(
        F.kll_sketch_agg_double(F.col("price").cast("double"), KLL_SIZE).alias("prices"), F.hll_sketch_agg(F.col(item), HLL_BITS).alias("items"),
        F.count("*").alias("n"),
    )


def span_summary(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75), first: str | None = None,
                 last: str | None = None) -> DataFrame:
    """(keys, n, items, quantiles) over the days from ``first`` to ``last``, from stored sketches alone.

    Ranks and numbers are within RANK_ERROR and COUNT_ERROR; ``series`` and ``market`` have the exact ways.
    """
    rows = sketches
    if first is not None:
        rows = rows.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("day") <= F.lit(last).cast("date"))
    merged = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("items"), F.kll_merge_agg_double("prices").alias("_prices"),
    )
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("_prices", F.lit(float(s))) for s in shares])
    return merged.select(*keys, "n", "items", quantiles.alias("quantiles"))
