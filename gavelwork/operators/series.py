"""Daily price series per product, source and condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelwork.functions import numbers, text
from gavelwork.operators.histogram import histogram_medians, price_histogram
from gavelwork.rules import fixed

#: ``product_id`` of a series is the key of the product (its type and id, see ``text.product_key``).
KEY = ["product_id", "price_date", "source", "condition_category"]


def series_key(listings: DataFrame) -> DataFrame:
    """Adds ``_day`` (the written calendar date of the sale, else of the creation) and ``_slot``,
    the condition class of a series."""
    day = F.col("sold_date")
    if "created_at" in listings.columns:
        day = F.coalesce(day, F.col("created_at"))
    return listings.withColumns({
        "_day": F.to_date(day), "_slot": text.condition_slot(F.col("is_graded"), F.col("condition_category")),
    })


def daily_rows(listings: DataFrame, source: str | None = None) -> DataFrame:
    """Listings that can enter a series, with their series key.

    Rows without a day or with a price that is not positive are left out. Listings with a
    product type get the product's key in place of its id.
    """
    rows = series_key(listings).withColumns({"price_date": F.col("_day"), "condition_category": F.col("_slot")}).drop("_day", "_slot")
    if source is not None:
        rows = rows.withColumn("source", F.lit(source))
    if "product_type" in listings.columns:
        rows = rows.withColumn("product_id", text.product_key())
    return rows.filter((F.col("price") > 0) & F.col("price_date").isNotNull())


def count_rows(listings: DataFrame) -> DataFrame:
    """Listings counted by what series and market summaries depend on (``ingest.COUNT_KEY``).

    All listings count, also those that enter no series: such rows have no day, or no positive price.
    """
    keyed = series_key(listings).select(
        text.product_key().alias("product_id"), F.col("_day").alias("price_date"), "source", F.col("_slot").alias("condition_category"),
        "search_strategy", "sold_date", "price",
    )
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n_rows"))


def series_of_counts(counts: DataFrame) -> DataFrame:
    """Series rows of listings counted by ``count_rows``."""
    return medians_of_counts(counts.filter((F.col("price") > 0) & F.col("price_date").isNotNull()))


def medians_of_counts(counts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Series rows from listings counted by series key and price (``n_rows``)."""
    keys = [*keep, *KEY]
    histogram = counts.groupBy(*keys, "price").agg(F.sum("n_rows").alias("n_rows"))
    return _series_rows(histogram, keys)


def _series_rows(histogram: DataFrame, keys: list[str]) -> DataFrame:
    return histogram_medians(histogram, keys).select(
        *keys,
        numbers.half_up(F.col("median"), 2).alias("price"),
        numbers.half_up(F.least(F.lit(1.0), F.col("n_total") / 10), 2).alias("data_confidence"),
        F.col("n_total").alias("listing_count"),
    )


def daily_median_series(listings: DataFrame, source: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per product, day, source and condition: median price, confidence, count.

    ``keep`` names further columns that depend on the product only (its type, say).
    """
    keys = [*keep, *KEY]
    return _series_rows(price_histogram(daily_rows(listings, source), keys), keys)


def sample_titles(listings: DataFrame, source: str | None = None, n: int = 3) -> DataFrame:
    """The first ``n`` titles (by listing id) behind each series point.

    The rank filter is pushed below the shuffle, so a busy day sends at most ``n`` rows
    per input task.
    """
    first = Window.partitionBy(*KEY).orderBy("listing_id")
    rows = daily_rows(listings, source).select(*KEY, "listing_id", "title")
    return (
        rows.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= n)
        .filter(F.coalesce(F.col("title"), F.lit("")) != "")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "title"))).alias("_titles"))
        .select(*KEY, F.col("_titles.title").alias("sample_titles"))
    )


def chart_series(points: DataFrame, source: str = "pricecharting") -> DataFrame:
    """Chart points as series rows: condition market, confidence 0.8."""
    return points.filter(F.col("price") > 0).select(
        "product_id",
        "price_date",
        numbers.half_up(F.col("price"), 2).alias("price"),
        F.lit(source).alias("source"),
        F.lit("market").alias("condition_category"),
        F.lit(0.8).alias("data_confidence"),
        F.lit(1).cast("bigint").alias("listing_count"),
    )


def current_price_series(current: DataFrame, as_of: Column, source: str = "pricecharting") -> DataFrame:
    """Current prices (a map condition -> price per product) as series rows of today.

    Labels of prices found in plain tables (``table_price_n``) are no conditions and are
    left out.
    """
    return (
        current.select("product_id", F.explode("current_prices").alias("condition_category", "price"))
        .filter((F.col("price") > 0) & ~F.col("condition_category").startswith("table_price_"))
        .select(
            "product_id",
            as_of.cast("date").alias("price_date"),
            numbers.half_up(F.col("price"), 2).alias("price"),
            F.lit(source).alias("source"),
            "condition_category",
            F.lit(0.9).alias("data_confidence"),
            F.lit(1).cast("bigint").alias("listing_count"),
        )
    )


def scan_series(series: DataFrame, product_ids=None, days_back: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Series of some products, at most ``days_back`` old, oldest first per product."""
    rows = series
    if product_ids is not None:
        rows = rows.filter(F.col("product_id").isin(*product_ids))
    if days_back:
        rows = rows.filter(F.col("price_date") >= F.date_sub(as_of.cast("date"), days_back))
    return rows.orderBy("product_id", "price_date", "source", "condition_category")


def series_summary(series: DataFrame) -> DataFrame:
    """Count, date range, price range, mean and number of sources per product."""
    return series.groupBy("product_id").agg(
        F.count("*").alias("total_data_points"),
        F.min("price_date").alias("start_date"),
        F.max("price_date").alias("end_date"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("price").alias("average_price"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def series_slots(series: DataFrame, slots=None) -> DataFrame:
    """Series points per product in their valid source / condition slots.

    A slot is an array in date order; its length is bounded by the number of days.
    """
    pairs = slots or fixed.SERIES_SLOTS
    valid = F.lit(False)
    for source, conditions in pairs.items():
        valid = valid | ((F.col("source") == source) & F.col("condition_category").isin(*conditions))
    point = F.struct("price_date", "price", "data_confidence", "listing_count")
    return (
        series.filter(valid)
        .groupBy("product_id", "source", "condition_category")
        .agg(F.sort_array(F.collect_list(point)).alias("points"))
    )


def data_quality_score(summary: DataFrame) -> DataFrame:
    """0-1 score from volume (40), number of sources (30) and time span (30)."""
    days = F.datediff("end_date", "start_date")
    n_sources = F.size("sources")
    points = (
        numbers.steps(F.col("total_data_points"), fixed.VOLUME_POINTS, 0)
        + F.when(n_sources >= 2, 30).when(n_sources == 1, 15).otherwise(0)
        + numbers.steps(days, fixed.SPAN_POINTS, 0)
    )
    return summary.select(
        "product_id",
        "total_data_points",
        n_sources.alias("source_count"),
        days.alias("date_range_days"),
        F.least(F.lit(1.0), points / 100).alias("quality_score"),
    )


def listing_date_range(listings: DataFrame) -> DataFrame:
    """Earliest and latest day of every product's listings, creation before sale."""
    seen = F.coalesce(F.col("created_at"), F.col("sold_date"))
    return listings.groupBy("product_type", "product_id").agg(
        F.min(seen).alias("earliest"), F.max(seen).alias("latest")
    )


def store_bucketed(series: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """The series as catalog table ``name`` at ``path``, dealt by product into buckets of one sorted file.

    Jobs that group or order within products plan no exchange on it. ``buckets`` defaults to the
    session's shuffle partitions; a bucket should fit a task.
    """
    spark = series.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = series.repartition(buckets, "product_id")
    dealt.write.mode("overwrite").bucketBy(buckets, "product_id").sortBy(*KEY).option("path", path).saveAsTable(name)
    return spark.table(name)


def create_functions(spark: SparkSession, series_table: str = "stored_series") -> None:
    """SQL table functions over a table or view of series, for this session:

    ``price_history(key, since)`` gives the points of a product, ``price_summary(key)`` one row about
    them. With a lateral join they are one plan for any number of products.
    """
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION price_history(key STRING, since DATE)
      RETURNS TABLE (price_date DATE, source STRING, condition_category STRING, price DOUBLE)
      RETURN SELECT price_date, source, condition_category, price FROM {series_table}
        WHERE product_id = price_history.key AND price_date >= price_history.since""")
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION price_summary(key STRING)
      RETURNS TABLE (points BIGINT, lowest DOUBLE, average DOUBLE, highest DOUBLE, first_day DATE, last_day DATE)
      RETURN SELECT count(*), min(price), avg(price), max(price), min(price_date), max(price_date) FROM {series_table}
        WHERE product_id = price_summary.key""")
