"""Dedup, merges and appends, in batch and as a stream."""

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators import audits, ingest, series
from gavelwork.registry.base import (
    AS_OF, LISTINGS, PRODUCT_KEY, SERIES, as_of, day, days_as_text, hu, query, stamp, with_,
)
from gavelwork.session import TIDY, scratch_path, settings
from gavelwork.sources import starviews as views
from gavelwork.streaming import ingest as stream

SPLIT = "1999-01-01"


def rows(spark, sf_dir, created=False):
    return views.listings(spark, sf_dir, with_created=created)


_FIRST = "SELECT *, row_number() OVER (PARTITION BY listing_url ORDER BY listing_id) AS rn FROM {}"


@query("dedup_url", with_(LISTINGS) + f"""
SELECT listing_url, listing_id, product_id, price FROM ({_FIRST.format('listings')}) WHERE rn = 1""")
def dedup_url(spark, sf_dir):
    return ingest.first_per_url(rows(spark, sf_dir)).select("listing_url", "listing_id", "product_id", "price")


def parts(spark, sf_dir):
    """Listings sold before (stored) and after (incoming) a day."""
    both = rows(spark, sf_dir)
    return both.filter(F.col("sold_date") < SPLIT), both.filter(F.col("sold_date") >= SPLIT)


_PARTS = f"""
stored AS (SELECT * FROM listings WHERE sold_date < TIMESTAMP '{SPLIT}'),
incoming AS (SELECT * FROM listings WHERE sold_date >= TIMESTAMP '{SPLIT}')"""


@query("new_listings", with_(LISTINGS, _PARTS) + f"""
SELECT listing_url, listing_id, price FROM ({_FIRST.format('incoming')})
WHERE rn = 1 AND listing_url NOT IN (SELECT listing_url FROM stored)""")
def new_listings(spark, sf_dir):
    stored, incoming = parts(spark, sf_dir)
    return ingest.new_listings(incoming, stored).select("listing_url", "listing_id", "price")


# incoming points overlap the stored ones: the incoming series takes the graded listings a second time
_MERGE = SERIES.replace("series AS (", "old AS (").replace("FROM listings WHERE", "FROM stored WHERE") + "," + (
    SERIES.replace("series AS (", "fresh AS (").replace("FROM listings WHERE", "FROM (SELECT * FROM listings WHERE is_graded) WHERE")
).strip()


@query("series_merge", with_(LISTINGS, _PARTS, _MERGE) + f"""
SELECT product_id, {day('price_date')} AS price_date, source, condition_category, price, data_confidence, listing_count FROM (
  SELECT * FROM fresh UNION ALL SELECT * FROM old ANTI JOIN fresh USING (product_id, price_date, source, condition_category))""")
def series_merge(spark, sf_dir):
    """Upsert into a stored table: written once, merged, read back."""
    stored, _ = parts(spark, sf_dir)
    path = scratch_path(spark, "series")
    ingest.store_series(path, series.daily_median_series(stored))
    ingest.store_series(path, series.daily_median_series(rows(spark, sf_dir).filter(F.col("is_graded"))))
    return days_as_text(ingest.read_merged(spark, path))


@query("insert_missing", """
SELECT s_suppkey AS product_id, s_name AS product_name FROM supplier
WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def insert_missing(spark, sf_dir):
    stored = views.read(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("product_id"))
    incoming = views.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("product_id"), F.col("s_name").alias("product_name")
    )
    return ingest.insert_missing(stored, incoming, ["product_id"])


_PRODUCTS = """
products AS (SELECT 'card' AS product_type, CAST(c_custkey AS VARCHAR) AS product_id, c_name AS product_name, c_mktsegment AS set_name,
  TIMESTAMP '2000-01-01' AS last_data_update, 0.75::DECIMAL(3,2) AS data_quality_score FROM customer),
candidates AS (SELECT 'card' AS product_type, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS set_name FROM part)"""


def products(spark, sf_dir):
    return views.read(spark, sf_dir, "customer").select(
        ingest.surrogate_key("c_custkey").alias("id"),
        F.lit("card").alias("product_type"), F.col("c_custkey").cast("string").alias("product_id"),
        F.col("c_name").alias("product_name"), F.col("c_mktsegment").alias("set_name"),
        F.lit("2000-01-01").cast("timestamp").alias("last_data_update"),
        F.lit("0.75").cast("decimal(3,2)").alias("data_quality_score"),
    )


@query("ensure_products", with_(_PRODUCTS) + f"""
SELECT product_type, product_id, product_name, set_name, {stamp('last_data_update')} AS last_data_update,
  CAST(data_quality_score AS DOUBLE) AS data_quality_score FROM products
UNION ALL SELECT product_type, product_id, product_name, set_name, '{AS_OF} 00:00:00', 0.5
FROM candidates WHERE product_id NOT IN (SELECT product_id FROM products)""")
def ensure_products(spark, sf_dir):
    candidates = views.read(spark, sf_dir, "part").select(
        F.lit("card").alias("product_type"), F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"), F.col("p_brand").alias("set_name"),
    )
    return days_as_text(ingest.ensure_products(products(spark, sf_dir), candidates, as_of()).drop("id"))


@query("touch_products", with_(_PRODUCTS) + f"""
SELECT product_id, CASE WHEN product_id IN (SELECT product_id FROM candidates) THEN '{AS_OF} 00:00:00' ELSE {stamp('last_data_update')} END AS last_data_update
FROM products""")
def touch_products(spark, sf_dir):
    touched = views.read(spark, sf_dir, "part").select(
        F.lit("card").alias("product_type"), F.col("p_partkey").cast("string").alias("product_id")
    )
    done = ingest.touch_products(products(spark, sf_dir), touched, as_of())
    return days_as_text(done.select("product_id", "last_data_update"))


@query("reset_products", with_(_PRODUCTS, """
series AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS product_id, CAST(ts AS DATE) AS d FROM events)""") + f"""
SELECT product_id, CASE WHEN product_id NOT IN (SELECT product_id FROM series) THEN {stamp('last_data_update')} END AS last_data_update,
  CASE WHEN product_id NOT IN (SELECT product_id FROM series) THEN 0.75 ELSE 0.0 END::DOUBLE AS data_quality_score,
  (SELECT count(*) FROM series WHERE product_id NOT IN (SELECT product_id FROM products)) AS points_left
FROM products""")
def reset_products(spark, sf_dir):
    points = views.chart_points(spark, sf_dir).select(F.col("product_id").cast("string").alias("product_id"), "price_date").distinct()
    cleared, left = ingest.reset_products(products(spark, sf_dir), points)
    counted = left.agg(F.count("*").alias("n")).scalar()
    return days_as_text(cleared.select("product_id", "last_data_update", "data_quality_score", counted.alias("points_left")))


@query("catalog_defaults", """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'card' ELSE 'sealed' END AS product_type,
  p_name || CASE p_partkey % 3 WHEN 0 THEN ' 151' WHEN 1 THEN ' Elite Trainer Box' ELSE '' END AS product_name,
  CASE WHEN p_partkey % 3 = 0 THEN '151' ELSE 'Unknown' END AS set_name,
  CASE WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'Elite Trainer Box' ELSE 'Booster Box' END AS sealed_type,
  CASE WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 49.99::DOUBLE ELSE 143.64::DOUBLE END AS msrp
FROM part""")
def catalog_defaults(spark, sf_dir):
    key = F.col("p_partkey")
    tail = F.when(key % 3 == 0, " 151").when(key % 3 == 1, " Elite Trainer Box").otherwise("")
    names = views.read(spark, sf_dir, "part").select(
        F.when(key % 2 == 0, "card").otherwise("sealed").alias("product_type"), F.concat("p_name", tail).alias("product_name")
    )
    return ingest.catalog_defaults(names).select("product_type", "product_name", "set_name", "sealed_type", "msrp")


# -- streams: the line items land as files -------------------------------------------------------------


def landed(spark, sf_dir, files=16, batches=4):
    """The line items as a stream of listings that lands in several files, some of them in each batch, in no
    order of time; all rows of an order are in one file."""
    folder = scratch_path(spark, "landed")
    items = views.read(spark, sf_dir, "lineitem")
    with settings(spark, TIDY):
        items.repartition(files, "l_orderkey").write.parquet(folder)
    raw = stream.landed(spark, folder, items.schema, files_per_trigger=files // batches)
    return views.listings_of(raw).withColumn("created_at", F.col("sold_date").cast("timestamp"))


@query("incremental_ingest", with_(LISTINGS) + f"""
SELECT listing_url, listing_id, product_type, product_id, price, {stamp('sold_date')} AS sold_date
FROM ({_FIRST.format('listings')}) WHERE rn = 1""")
def incremental_ingest(spark, sf_dir):
    """Every URL of every batch is stored once, with its first listing, however old it is."""
    table = stream.ingest_once(spark, landed(spark, sf_dir))
    return days_as_text(table.select("listing_url", "listing_id", "product_type", "product_id", "price", "sold_date"))


def refreshed(spark, sf_dir):
    """Paths of counts, series and summaries after streamed passes over listings without repeats."""
    from gavelwork.functions.text import search_strategy

    table, state = scratch_path(spark, "touched-table"), scratch_path(spark, "touched-state")
    counts, points, summary = (scratch_path(spark, f"touched-{name}") for name in ("counts", "series", "summary"))
    url = F.concat_ws("-", "listing_id", F.format_string("%.2f", "price"))
    source = landed(spark, sf_dir, batches=2).withColumn("listing_url", url).withColumn(
        "search_strategy", search_strategy(F.col("search_terms"), F.col("product_type") == "sealed")
    )
    refresh = stream.refresh_touched(counts, points, summary, as_of())
    stream.start_ingest(source, table, state, refresh).awaitTermination()
    return counts, points, summary


@query("touched_refresh", with_(LISTINGS, SERIES) + f"""
SELECT product_id, {day('price_date')} AS price_date, source, condition_category, price, data_confidence, listing_count FROM series""")
def touched_refresh(spark, sf_dir):
    return days_as_text(ingest.read_merged(spark, refreshed(spark, sf_dir)[1]))


@query("stored_market_summary", with_(LISTINGS) + f"""
SELECT {PRODUCT_KEY} AS product_id, count(*) AS total_listings, {hu('avg(price) FILTER (WHERE price > 0)', 4)} AS avg_price,
  min(price) FILTER (WHERE price > 0) AS lowest_price, max(price) FILTER (WHERE price > 0) AS highest_price
FROM listings GROUP BY 1""")
def stored_market_summary(spark, sf_dir):
    """What the refresh has stored for every product, read back."""
    stored = ingest.read_merged(spark, refreshed(spark, sf_dir)[2])
    return stored.select("product_id", "total_listings", half_up(F.col("avg_price"), 4).alias("avg_price"), "lowest_price", "highest_price")


@query("stream_daily_counts", with_(LISTINGS) + f"""
SELECT {day('sold_date')} AS day, product_type, product_id, count(*) AS listings, {hu('avg(price)', 4)} AS avg_price FROM listings
GROUP BY ALL""")
def stream_daily_counts(spark, sf_dir):
    table, state = scratch_path(spark, "counts"), scratch_path(spark, "counts-state")
    stream.start_daily_counts(landed(spark, sf_dir), table, state).awaitTermination()
    return stream.daily_counts(spark, table).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "product_type", "product_id", "listings",
        half_up(F.col("avg_price"), 4).alias("avg_price"),
    )


# -- run log: one entry per order, its line items are the points -------------------------------------------


@query("run_rollup", """
WITH items AS (
  SELECT o_orderkey, o_custkey % 100 AS item, o_orderstatus <> 'F' AS success, o_totalprice / 1000 AS p FROM orders
)
SELECT count(*) AS total_targets, count(*) FILTER (WHERE success) AS successful_collections,
  count(*) - count(*) FILTER (WHERE success) AS failed_collections,
  """ + hu("count(*) FILTER (WHERE success) / count(*) * 100", 4) + """ AS success_rate,
  CAST(sum((p BETWEEN 1 AND 100000 AND p <> 6.0)::INT + 1) AS BIGINT) AS filtered_prices,
  CAST(sum(1 + (o_orderkey % 2)) AS BIGINT) AS clean_historical, CAST(sum(o_orderkey % 2) AS BIGINT) AS clean_table
FROM items""")
def run_rollup(spark, sf_dir):
    return audits.run_totals(audits.run_rollup(run_log(spark, sf_dir)))


def run_log(spark, sf_dir):
    price, odd = F.col("o_totalprice") / 1000, F.col("o_orderkey") % 2 == 1

    def point(date):
        return F.struct(date.cast("string").alias("date"), price.alias("price"))

    good, bad = point(F.to_date("o_orderdate")), point(F.lit(None))
    return views.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("item_name"), F.lit("card").alias("item_type"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.create_map(F.lit("current"), price, F.lit("fee"), F.lit(6.0), F.lit("new"), F.lit(25.0)).alias("current_prices"),
        F.array(good, F.when(odd, good).otherwise(bad)).alias("chart_points"),
        F.array(F.when(odd, good).otherwise(bad)).alias("table_points"),
    )


@query("richest_items", """
SELECT CAST(o_orderkey AS VARCHAR) AS item_name, 1 + 2 * (o_orderkey % 2) AS total_clean_data_points FROM orders
ORDER BY 2 DESC, 1 LIMIT 5""")
def richest_items(spark, sf_dir):
    top = audits.richest_items(audits.run_rollup(run_log(spark, sf_dir)))
    return top.select("item_name", F.col("total_clean_data_points").cast("bigint").alias("total_clean_data_points"))


