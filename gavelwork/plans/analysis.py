"""Listings to series to metrics to verdicts, for all products in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.operators import decide, ingest, metrics, quality, series


def aggregate_listings(listings: DataFrame, source: str | None = None, filtered: bool = True) -> DataFrame:
    """Quality filter, then daily median series (the product type is kept).

    The filter's outcome hangs on group, price and rule reason only, so listings are counted
    by these and the series key, limits are found on the counts, and the medians are read off
    the counts that are left: one scan, no join, and no listing row is shuffled.
    """
    if not filtered:
        return series.daily_median_series(listings, source, keep=("product_type",))
    keyed = series.series_key(listings)
    counts = quality.filter_counts(keyed, by=("_day", "_slot")).filter(F.col("removed_by").isNull())
    rows = counts.filter((F.col("price") > 0) & F.col("_day").isNotNull()).select(
        "product_type", text.product_key().alias("product_id"), F.col("_day").alias("price_date"),
        (F.col("source") if source is None else F.lit(source)).alias("source"), F.col("_slot").alias("condition_category"),
        "price", "n_rows",
    )
    return series.medians_of_counts(rows, keep=("product_type",))


def filtered_series(points: DataFrame) -> DataFrame:
    """Series points within the outlier limits of their source and condition.

    Title rules do not apply here: a stored series holds no titles.
    """
    return quality.with_statistical_reason(
        points, product=["product_id"], group=["product_id", "source", "condition_category"]
    ).filter(F.col("stat_reason").isNull()).drop("stat_reason", "lower_bound", "upper_bound")


def analyze(points: DataFrame, as_of: Column, second_verdicts: DataFrame | None = None) -> DataFrame:
    """Analysis records (version 2.0) of every product of a series."""
    graded = decide.investment_grade(metrics.metric_bundle(points))
    if second_verdicts is not None:
        graded = graded.join(second_verdicts, "product_id", "left")
        return decide.analysis_record(decide.graded_recommendation(graded, "second_verdict"), as_of)
    return decide.analysis_record(decide.graded_recommendation(graded), as_of)


def analyze_simple(points: DataFrame) -> DataFrame:
    """Simple analysis (version 1.0) with its recommendation, one row per product."""
    basic = metrics.basic_analysis(points)
    verdict = decide.recommendation(basic).select(
        "product_id", "score", "recommendation", "confidence", "risk_level", "buy_below", "sell_above", "reasoning"
    )
    return basic.join(verdict, "product_id")


def analyze_missing(products: DataFrame, points: DataFrame, analyses: DataFrame, as_of: Column,
                    max_age_hours: int = 24) -> DataFrame:
    """Analysis records for the products without a young enough analysis.

    The cache is a join: products with a hit never reach the metric job.
    """
    cached = decide.cached_analyses(analyses, as_of, max_age_hours, "2.0")
    open_products = products.join(cached.select("product_id"), "product_id", "left_anti")
    return analyze(points.join(open_products.select("product_id"), "product_id", "left_semi"), as_of)


def run(listings: DataFrame, series_path: str, analyses_path: str, as_of: Column) -> None:
    """Refresh the stored series from listings and append an analysis of every product."""
    spark = listings.sparkSession
    ingest.store_series(series_path, aggregate_listings(listings).drop("product_type"))
    ingest.store_analyses(analyses_path, analyze(ingest.read_merged(spark, series_path), as_of))
