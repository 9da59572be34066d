"""Daily series, summaries and quality scores."""

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators import metrics, series
from gavelwork.operators.histogram import histogram_medians, price_histogram
from gavelwork.registry.base import (
    AS_OF, CREATED, EVENT_SERIES, LISTINGS, PRODUCT_KEY, SERIES, as_of, daily_series, day, days_as_text, hu, query, stamp, when, with_,
)
from gavelwork.rules import fixed
from gavelwork.sources import starviews as views


@query("daily_median_series", with_(LISTINGS, SERIES) + f"""
SELECT product_id, {day('price_date')} AS price_date, source, condition_category, price, data_confidence, listing_count
FROM series""")
def daily_median_series(spark, sf_dir):
    return days_as_text(daily_series(spark, sf_dir))


@query("sample_titles", with_(LISTINGS) + f"""
SELECT {PRODUCT_KEY} AS product_id, {day('price_date')} AS price_date, source, condition_category,
  string_agg(title, ' | ' ORDER BY rank) AS titles
FROM (
  SELECT *, CAST(sold_date AS DATE) AS price_date, row_number() OVER (
    PARTITION BY product_type, product_id, CAST(sold_date AS DATE), source, condition_category ORDER BY listing_id) AS rank
  FROM listings WHERE price > 0)
WHERE rank <= 3 GROUP BY 1, 2, 3, 4""")
def sample_titles(spark, sf_dir):
    rows = series.sample_titles(views.listings(spark, sf_dir))
    return days_as_text(rows.withColumn("titles", F.array_join("sample_titles", " | ")).drop("sample_titles"))


@query("series_summary", with_(LISTINGS, SERIES) + f"""
SELECT product_id, count(*) AS total_data_points, {day('min(price_date)')} AS start_date,
  {day('max(price_date)')} AS end_date, min(price) AS min_price, max(price) AS max_price,
  {hu('avg(price)', 4)} AS average_price, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM series GROUP BY product_id""")
def series_summary(spark, sf_dir):
    rows = series.series_summary(daily_series(spark, sf_dir))
    return days_as_text(
        rows.withColumn("average_price", half_up(F.col("average_price"), 4))
        .withColumn("sources", F.array_join("sources", ","))
    )


_VALID = " OR ".join(
    f"(source = '{s}' AND condition_category IN ({', '.join(repr(c) for c in cs)}))"
    for s, cs in fixed.SERIES_SLOTS.items()
)


@query("series_slots", with_(LISTINGS, SERIES) + f"""
SELECT product_id, source, condition_category, count(*) AS points,
  string_agg(printf('%s=%.2f', {day('price_date')}, price), ',' ORDER BY price_date) AS path
FROM series WHERE {_VALID} GROUP BY 1, 2, 3""")
def series_slots(spark, sf_dir):
    rows = series.series_slots(daily_series(spark, sf_dir))
    step = F.transform(
        "points", lambda p: F.concat(p["price_date"].cast("string"), F.lit("="), F.format_string("%.2f", p["price"]))
    )
    return rows.select(
        "product_id", "source", "condition_category", F.size("points").cast("bigint").alias("points"),
        F.array_join(step, ",").alias("path"),
    )


_VOLUME = when([(f"count(*) >= {a}", str(p)) for a, p in fixed.VOLUME_POINTS], "0")
_SPAN = when([(f"date_diff('day', min(price_date), max(price_date)) >= {a}", str(p)) for a, p in fixed.SPAN_POINTS], "0")


@query("data_quality_score", with_(LISTINGS, SERIES) + f"""
SELECT product_id, count(*) AS total_data_points, count(DISTINCT source) AS source_count,
  date_diff('day', min(price_date), max(price_date)) AS date_range_days,
  least(1.0, ({_VOLUME} + CASE WHEN count(DISTINCT source) >= 2 THEN 30 ELSE 15 END + {_SPAN}) / 100.0)::DOUBLE AS quality_score
FROM series GROUP BY product_id""")
def data_quality_score(spark, sf_dir):
    return series.data_quality_score(series.series_summary(daily_series(spark, sf_dir)))


@query("chart_series", f"""
SELECT user_id AS product_id, {day('ts')} AS price_date, value AS price, 'pricecharting' AS source,
  'market' AS condition_category, 0.8::DOUBLE AS data_confidence, 1::BIGINT AS listing_count
FROM events WHERE value > 0
UNION ALL
SELECT p_partkey, '{views.EVENTS_AS_OF}', {hu('price', 2)}, 'pricecharting', label, 0.9::DOUBLE, 1::BIGINT
FROM (SELECT p_partkey, unnest(['loose', 'new', 'table_price_2']) AS label,
        unnest([p_retailprice / 12, p_retailprice / 4, p_retailprice]) AS price FROM part)
WHERE price > 0 AND label NOT LIKE 'table_price_%'""")
def chart_series(spark, sf_dir):
    now = F.lit(views.EVENTS_AS_OF).cast("timestamp")
    price = F.col("p_retailprice")
    labels = F.create_map(
        F.lit("loose"), price / 12, F.lit("new"), price / 4, F.lit("table_price_2"), price
    )
    current = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), labels.alias("current_prices"))
    points = series.chart_series(views.chart_points(spark, sf_dir))
    return days_as_text(points.unionByName(series.current_price_series(current, now)))


@query("price_series_scan", with_(LISTINGS, SERIES) + f"""
SELECT product_id, {day('price_date')} AS price_date, source, condition_category, price
FROM series WHERE price_date >= DATE '{AS_OF}' - INTERVAL 365 DAY""")
def price_series_scan(spark, sf_dir):
    rows = series.scan_series(daily_series(spark, sf_dir), days_back=365, as_of=as_of())
    return days_as_text(rows.select("product_id", "price_date", "source", "condition_category", "price"))


@query("source_breakdown", with_(LISTINGS, SERIES) + f"""
SELECT product_id, source, count(*) AS count, {hu('avg(price)', 2)} AS average,
  {hu('min(price)', 2)} AS range_low, {hu('max(price)', 2)} AS range_high
FROM series GROUP BY product_id, source""")
def source_breakdown(spark, sf_dir):
    return metrics.source_breakdown(daily_series(spark, sf_dir))


def event_series(spark, sf_dir):
    """Daily medians per user and event type; bounded by days x types per user."""
    points = views.chart_points(spark, sf_dir).withColumn("condition_category", F.lit("market"))
    keys = ["product_id", "price_date", "source", "condition_category"]
    medians = histogram_medians(price_histogram(points.filter(F.col("price") > 0), keys), keys)
    return medians.select(*keys, half_up(F.col("median"), 2).alias("price"))


@query("event_daily_series", with_(EVENT_SERIES) + f"""
SELECT product_id, {day('price_date')} AS price_date, source, condition_category, price FROM series""")
def event_daily_series(spark, sf_dir):
    return days_as_text(event_series(spark, sf_dir))


@query("listing_date_range", with_(LISTINGS, CREATED) + f"""
SELECT product_type, product_id, {stamp('min(coalesce(created_at, sold_date))')} AS earliest,
  {stamp('max(coalesce(created_at, sold_date))')} AS latest
FROM created GROUP BY ALL""")
def listing_date_range(spark, sf_dir):
    return days_as_text(series.listing_date_range(views.listings(spark, sf_dir, with_created=True)))
