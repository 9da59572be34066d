"""Market summaries, insights, product views, freshness, offline preparation."""

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators import audits, decide, market, metrics
from gavelwork.plans import preparation
from gavelwork.registry.base import (
    AS_OF, CARDS, CHART_NOW, CREATED, LISTINGS, POINTS, SEALED, SERIES, as_of, daily_series, day, days_as_text,
    hu, listings, query, stamp, with_,
)
from gavelwork.rules import fixed
from gavelwork.sources import starviews as views

NOW = f"TIMESTAMP '{AS_OF}'"


def _strategy_sql(name, strategy):
    of = f"search_strategy = '{strategy}'"
    positive = f"FILTER (WHERE {of} AND price > 0)"
    return f"""
    count(*) FILTER (WHERE {of}) AS {name}_sold_count,
    {hu(f'coalesce(avg(price) {positive}, 0)', 2)} AS {name}_avg_price,
    {hu(f'coalesce(median(price) {positive}, 0)', 2)} AS {name}_median_price,
    {hu(f'coalesce(min(price) {positive}, 0)', 2)} AS {name}_lowest_price,
    {hu(f'coalesce(max(price) {positive}, 0)', 2)} AS {name}_highest_price"""


def _premium_sql(name):
    return hu(
        f"CASE WHEN raw_avg_price > 0 AND {name}_avg_price > 0 THEN ({name}_avg_price / raw_avg_price - 1) * 100 ELSE 0 END", 2
    )


_LEVEL = "CASE WHEN recent_sales >= 20 THEN 'high' WHEN recent_sales >= 5 THEN 'medium' ELSE 'low' END"
_SUMMARY = f"""
sums AS (
  SELECT product_id, count(*) AS total_listings, coalesce(avg(price) FILTER (WHERE price > 0), 0) AS avg_price,
    coalesce(min(price) FILTER (WHERE price > 0), 0) AS lowest_price,
    coalesce(max(price) FILTER (WHERE price > 0), 0) AS highest_price,
    count(*) FILTER (WHERE sold_date >= {NOW} - INTERVAL 30 DAY) AS recent_sales,
    {','.join(_strategy_sql(*s) for s in market.STRATEGIES)}
  FROM listings WHERE product_type = 'card' GROUP BY product_id
),
summary AS (
  SELECT *, {_premium_sql('psa9')} AS grading_premium_psa9, {_premium_sql('psa10')} AS grading_premium_psa10,
    {_LEVEL} AS market_liquidity FROM sums
)"""


def card_listings(spark, sf_dir, created=False):
    return listings(spark, sf_dir, created).filter(F.col("product_type") == "card")


def summaries(spark, sf_dir):
    return market.market_summary(card_listings(spark, sf_dir), as_of())


@query("market_summary", with_(LISTINGS, _SUMMARY) + f"SELECT * REPLACE ({hu('avg_price', 4)} AS avg_price) FROM summary")
def market_summary(spark, sf_dir):
    return summaries(spark, sf_dir).withColumn("avg_price", half_up(F.col("avg_price"), 4))


@query("grading_premium", with_(LISTINGS, _SUMMARY) + """
SELECT product_id, raw_avg_price, psa9_avg_price, psa10_avg_price, grading_premium_psa9, grading_premium_psa10 FROM summary
WHERE grading_premium_psa9 <> 0 OR grading_premium_psa10 <> 0""")
def grading_premium(spark, sf_dir):
    return summaries(spark, sf_dir).filter(
        (F.col("grading_premium_psa9") != 0) | (F.col("grading_premium_psa10") != 0)
    ).select(
        "product_id", "raw_avg_price", "psa9_avg_price", "psa10_avg_price", "grading_premium_psa9", "grading_premium_psa10"
    )


@query("liquidity", with_(LISTINGS, f"""
recent AS (
  SELECT product_id, count(*) FILTER (WHERE sold_date >= {NOW} - INTERVAL 730 DAY) AS recent_sales FROM listings GROUP BY ALL
)""") + f"SELECT product_id, recent_sales, {_LEVEL} AS market_liquidity FROM recent")
def liquidity(spark, sf_dir):
    return market.liquidity(listings(spark, sf_dir), as_of(), days=730)


_OFFERS = """
offers AS (
  SELECT product_id, raw_avg_price, psa9_avg_price, psa10_avg_price, avg_price, total_listings, market_liquidity, 'top_value_raw_cards' AS insight, raw_avg_price AS value,
    raw_avg_price AS k FROM summary WHERE total_listings >= 3 AND raw_avg_price > 0
  UNION ALL SELECT product_id, raw_avg_price, psa9_avg_price, psa10_avg_price, avg_price, total_listings, market_liquidity, 'highest_psa10_premiums', grading_premium_psa10,
    -grading_premium_psa10 FROM summary WHERE total_listings >= 3 AND grading_premium_psa10 > 0
  UNION ALL SELECT product_id, raw_avg_price, psa9_avg_price, psa10_avg_price, avg_price, total_listings, market_liquidity, 'highest_psa9_premiums', grading_premium_psa9,
    -grading_premium_psa9 FROM summary WHERE total_listings >= 3 AND grading_premium_psa9 > 0
  UNION ALL SELECT product_id, raw_avg_price, psa9_avg_price, psa10_avg_price, avg_price, total_listings, market_liquidity, 'most_liquid_markets', total_listings,
    -total_listings FROM summary WHERE total_listings >= 3
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY insight ORDER BY k, product_id) AS position FROM offers)"""


@query("top_insights", with_(LISTINGS, _SUMMARY, _OFFERS) + """
SELECT insight, position, product_id, CAST(value AS DOUBLE) AS value, raw_avg_price, psa9_avg_price, psa10_avg_price,
  """ + hu("avg_price", 4) + """ AS avg_price, total_listings, market_liquidity
FROM ranked WHERE position <= 20""")
def top_insights(spark, sf_dir):
    return market.top_insights(summaries(spark, sf_dir)).withColumn("avg_price", half_up(F.col("avg_price"), 4))


@query("market_overview", with_(LISTINGS, _SUMMARY) + f"""
SELECT count(*) AS total_cards, CAST(coalesce(sum(total_listings), 0) AS BIGINT) AS total_listings,
  {hu('coalesce(sum(total_listings) / count(*), 0)', 1)} AS avg_listings_per_card,
  {hu('coalesce(avg(grading_premium_psa9) FILTER (WHERE grading_premium_psa9 > 0), 0)', 2)} AS avg_psa9_premium,
  {hu('coalesce(avg(grading_premium_psa10) FILTER (WHERE grading_premium_psa10 > 0), 0)', 2)} AS avg_psa10_premium,
  count(*) FILTER (WHERE market_liquidity = 'high') AS high_liquidity,
  count(*) FILTER (WHERE market_liquidity = 'medium') AS medium_liquidity,
  count(*) FILTER (WHERE market_liquidity = 'low') AS low_liquidity
FROM summary WHERE total_listings >= 3""")
def market_overview(spark, sf_dir):
    return market.market_overview(summaries(spark, sf_dir))


@query("simple_market_summary", with_(LISTINGS) + f"""
SELECT product_id, {hu('avg(price) FILTER (WHERE price > 0)', 4)} AS avg_price, min(price) FILTER (WHERE price > 0) AS lowest_price,
  max(price) FILTER (WHERE price > 0) AS highest_price, count(*) AS total_sales,
  {hu('avg(price) FILTER (WHERE is_graded AND price > 0)', 4)} AS avg_graded_price,
  count(*) FILTER (WHERE is_graded AND price > 0) AS graded_sales_count,
  {hu('avg(price) FILTER (WHERE NOT is_graded AND price > 0)', 4)} AS avg_raw_price,
  count(*) FILTER (WHERE NOT is_graded AND price > 0) AS raw_sales_count
FROM listings WHERE product_type = 'card' GROUP BY product_id HAVING count(*) FILTER (WHERE price > 0) > 0""")
def simple_market_summary(spark, sf_dir):
    return market.simple_summary(card_listings(spark, sf_dir))


@query("price_summary", with_(LISTINGS) + f"""
SELECT product_type, product_id, {hu('avg(price)', 4)} AS avg_price, min(price) AS min_price, max(price) AS max_price,
  count(*) AS total_sales, count(*) FILTER (WHERE sold_date >= {NOW} - INTERVAL 30 DAY) AS recent_sales
FROM listings GROUP BY ALL""")
def price_summary(spark, sf_dir):
    return market.price_summary(listings(spark, sf_dir), as_of())


@query("sealed_market_summary", with_(LISTINGS, SERIES.replace("series AS (", "series0 AS ("),
       "series AS (SELECT * FROM series0 WHERE condition_category = 'sealed')", POINTS, f"""
thirds AS (
  SELECT product_id, avg(price) FILTER (WHERE ord <= n // 3) AS early, avg(price) FILTER (WHERE back <= n // 3) AS late
  FROM points GROUP BY product_id
),
trends AS (
  SELECT product_id, CASE WHEN early IS NULL THEN 'stable' WHEN {hu('coalesce(abs(late - early) / early, 0) * 100', 2)} <= 5 THEN 'stable'
    WHEN late > early THEN 'rising' ELSE 'falling' END AS price_trend FROM thirds
)""") + f"""
SELECT listings.product_id AS sealed_product_id, {hu('avg(price)', 4)} AS avg_price, min(price) AS lowest_price, max(price) AS highest_price,
  count(*) AS total_sales, count(*) FILTER (WHERE sold_date >= {NOW} - INTERVAL 30 DAY) AS sales_last_30_days,
  coalesce(any_value(price_trend), 'stable') AS price_trend
FROM listings LEFT JOIN trends ON trends.product_id = concat_ws('-', listings.product_type, listings.product_id)
WHERE product_type = 'sealed' GROUP BY listings.product_id""")
def sealed_market_summary(spark, sf_dir):
    points = daily_series(spark, sf_dir).filter(F.col("condition_category") == "sealed")
    return market.sealed_market_summary(listings(spark, sf_dir), metrics.trend_thirds(points), as_of())


@query("upload_statistics", with_(LISTINGS, CREATED) + f"""
SELECT count(*) AS total_listings, count(DISTINCT product_id) AS unique_cards_tracked,
  count(*) FILTER (WHERE created_at >= date_trunc('day', TIMESTAMP '2001-07-30 15:00:00')) AS uploads_since_midnight,
  {hu('count(*) / count(DISTINCT product_id)', 4)} AS avg_listings_per_card
FROM created WHERE product_type = 'card'""")
def upload_statistics(spark, sf_dir):
    now = F.lit("2001-07-30 15:00:00").cast("timestamp")
    return market.upload_statistics(card_listings(spark, sf_dir, created=True), now)


@query("collection_summary", with_(LISTINGS) + """
SELECT 'condition' AS breakdown, condition_category AS value, count(*) AS listings, count(*) FILTER (WHERE price > 0) AS listings_with_prices
FROM listings GROUP BY ALL
UNION ALL
SELECT 'search_strategy', search_strategy, count(*), count(*) FILTER (WHERE price > 0) FROM listings GROUP BY ALL""")
def collection_summary(spark, sf_dir):
    return market.collection_summary(listings(spark, sf_dir))


# -- catalog against listings ------------------------------------------------------------------------
# Not every card counts as listed here: only graded listings are taken, so that some are missing.

_CARD_ROWS = "card_rows AS (SELECT * FROM created WHERE product_type = 'card')"
_CUTOFF = "2001-06-01"


def _now(text):
    return F.lit(text).cast("timestamp")


@query("coverage", with_(LISTINGS, CREATED, _CARD_ROWS, CARDS, """
seen AS (SELECT product_id AS card_id, max(created_at) AS last FROM card_rows GROUP BY ALL)""") + f"""
SELECT count(*) AS total_cards, count(last) AS cards_with_listings, count(*) - count(last) AS cards_never_listed,
  {hu('count(last) / count(*) * 100', 4)} AS completion_percentage,
  count(*) FILTER (WHERE last >= TIMESTAMP '{_CUTOFF}' - INTERVAL 90 DAY) AS cards_updated_recently
FROM cards LEFT JOIN seen USING (card_id)""")
def coverage(spark, sf_dir):
    return market.coverage(views.cards(spark, sf_dir), card_listings(spark, sf_dir, created=True), _now(_CUTOFF), days=90)


@query("stale_cards", with_(LISTINGS, CREATED, _CARD_ROWS, CARDS, """
seen AS (SELECT product_id AS card_id, max(created_at) AS last FROM card_rows GROUP BY ALL)""") + f"""
SELECT card_id, card_name, set_name, card_number, {stamp('last')} AS last_update,
  CAST(floor(epoch(TIMESTAMP '{_CUTOFF}' - last) / 86400) AS BIGINT) AS days_since_update
FROM cards LEFT JOIN seen USING (card_id)
WHERE last IS NULL OR last < TIMESTAMP '{_CUTOFF}' - INTERVAL 180 DAY""")
def stale_cards(spark, sf_dir):
    rows = market.stale_cards(views.cards(spark, sf_dir), card_listings(spark, sf_dir, created=True), _now(_CUTOFF), days=180)
    return days_as_text(rows.select(
        "card_id", "card_name", "set_name", "card_number", "last_update", "days_since_update"
    ))


@query("listing_counts", with_(LISTINGS) + """
SELECT product_type, product_id, count(*) AS listings FROM listings GROUP BY ALL""")
def listing_counts(spark, sf_dir):
    return market.listing_counts(views.listings(spark, sf_dir))


@query("recent_listings", with_(LISTINGS, CREATED) + f"""
SELECT product_type, product_id, listing_id, {stamp('created_at')} AS created_at, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY product_type, product_id ORDER BY created_at DESC, listing_id) AS recency FROM created)
WHERE recency <= 3""")
def recent_listings(spark, sf_dir):
    rows = market.recent_listings(views.listings(spark, sf_dir, with_created=True), 3)
    return days_as_text(rows.select("product_type", "product_id", "listing_id", "created_at", F.col("recency").cast("bigint").alias("recency")))


@query("recent_sales", with_(LISTINGS) + f"""
SELECT product_id, listing_id, title, price, {stamp('sold_date')} AS sold_date, condition
FROM listings WHERE product_type = 'sealed' AND sold_date >= {NOW} - INTERVAL 180 DAY""")
def recent_sales(spark, sf_dir):
    rows = listings(spark, sf_dir).filter(F.col("product_type") == "sealed")
    return days_as_text(market.recent_sales(rows, as_of(), days=180))


_UNION = """
all_listings AS (
  SELECT 'card' AS listing_type, listing_id, title, price, search_strategy, CAST(product_id AS VARCHAR) AS product_id,
    concat(card_name, ' - ', set_name) AS product_description
  FROM listings LEFT JOIN cards ON card_id = product_id WHERE listings.product_type = 'card'
  UNION ALL
  SELECT 'sealed', listing_id, title, price, search_strategy, CAST(product_id AS VARCHAR),
    concat(sealed.product_name, ' (', sealed.product_type, ')')
  FROM listings LEFT JOIN sealed ON sealed_product_id = product_id WHERE listings.product_type = 'sealed'
)"""


def union_rows(spark, sf_dir):
    from gavelwork.functions.text import whole_grade

    rows = listings(spark, sf_dir).withColumn("grade_numeric", whole_grade(F.col("grade")))
    return market.all_listings(
        rows.filter(F.col("product_type") == "card"), rows.filter(F.col("product_type") == "sealed"),
        views.cards(spark, sf_dir), views.sealed_products(spark, sf_dir),
    )


@query("all_listings_union", with_(LISTINGS, CARDS, SEALED, _UNION) + "SELECT * FROM all_listings")
def all_listings_union(spark, sf_dir):
    return union_rows(spark, sf_dir).select(
        "listing_type", "listing_id", "title", "price", "search_strategy", "product_id", "product_description"
    )


@query("listing_type_profile", with_(LISTINGS, CARDS, SEALED, _UNION) + f"""
SELECT listing_type, count(*) AS listing_count, {hu('avg(price)', 4)} AS avg_price, min(price) AS min_price, max(price) AS max_price
FROM all_listings GROUP BY ALL""")
def listing_type_profile(spark, sf_dir):
    return market.listing_type_profile(union_rows(spark, sf_dir))


# -- analyses, products, freshness ------------------------------------------------------------------------
# Orders play stored analyses of their customer's product; customers play products.

_ANALYSES = """
analyses AS (
  SELECT o_custkey AS product_id, o_orderkey AS analysis_id, o_orderdate + INTERVAL (o_orderkey % 1000) SECOND AS analysis_date,
    CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'HOLD' ELSE 'AVOID' END AS recommendation,
    CASE WHEN o_orderpriority LIKE '1%' THEN '1.0' ELSE '2.0' END AS analysis_version,
    (o_orderkey % 100) / 100.0 AS confidence_score
  FROM orders
),
products AS (
  SELECT c_custkey AS product_id, c_name AS product_name, c_mktsegment AS set_name, 'card' AS product_type FROM customer
)"""


def analyses(spark, sf_dir):
    return views.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("product_id"),
        F.col("o_orderkey").alias("analysis_id"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 1000).cast("decimal(18,6)"))).alias("analysis_date"),
        F.when(F.col("o_orderstatus") == "O", "BUY").when(F.col("o_orderstatus") == "F", "HOLD").otherwise("AVOID").alias("recommendation"),
        F.when(F.col("o_orderpriority").startswith("1"), "1.0").otherwise("2.0").alias("analysis_version"),
        ((F.col("o_orderkey") % 100) / 100).alias("confidence_score"),
    )


def products(spark, sf_dir):
    return views.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_name").alias("product_name"),
        F.col("c_mktsegment").alias("set_name"), F.lit("card").alias("product_type"),
    )


@query("latest_per_key", with_(_ANALYSES) + f"""
SELECT a.product_id, analysis_id, {stamp('analysis_date')} AS analysis_date, recommendation, product_name, set_name
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY analysis_date DESC, analysis_id DESC) AS rn FROM analyses) a
JOIN products p ON p.product_id = a.product_id WHERE rn = 1""")
def latest_per_key(spark, sf_dir):
    latest = decide.latest_per_key(analyses(spark, sf_dir), ["product_id"], "analysis_date", "analysis_id")
    rows = latest.join(products(spark, sf_dir), "product_id")
    return days_as_text(rows.select("product_id", "analysis_id", "analysis_date", "recommendation", "product_name", "set_name"))


@query("product_summary", with_(_ANALYSES, f"""
series AS (
  SELECT user_id AS product_id, CAST(ts AS DATE) AS price_date, {hu('median(value)', 2)} AS price FROM events
  WHERE value > 0 GROUP BY user_id, CAST(ts AS DATE)
),
latest AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY analysis_date DESC, analysis_id DESC) AS rn FROM analyses),
stats AS (
  SELECT product_id, count(*) AS c, min(price_date) AS d0, max(price_date) AS d1, {hu('avg(price)', 4)} AS a, min(price) AS p0, max(price) AS p1
  FROM series GROUP BY product_id
)""") + f"""
SELECT p.product_id, product_name, coalesce(c, 0) AS total_price_points, {day('d0')} AS earliest_price_date,
  {day('d1')} AS latest_price_date, a AS avg_price, p0 AS min_price, p1 AS max_price,
  recommendation AS latest_recommendation, CAST(confidence_score AS DOUBLE) AS latest_confidence, {stamp('analysis_date')} AS latest_analysis_date
FROM products p LEFT JOIN stats s ON s.product_id = p.product_id
LEFT JOIN latest l ON l.product_id = p.product_id AND rn = 1""")
def product_summary(spark, sf_dir):
    from gavelwork.operators.histogram import histogram_medians, price_histogram

    keys = ["product_id", "price_date"]
    points = views.chart_points(spark, sf_dir).filter(F.col("price") > 0)
    series = histogram_medians(price_histogram(points, keys), keys).select(*keys, half_up(F.col("median"), 2).alias("price"))
    latest = decide.latest_per_key(analyses(spark, sf_dir), ["product_id"], "analysis_date", "analysis_id")
    return days_as_text(market.product_summary(products(spark, sf_dir), series, latest).drop("set_name", "product_type"))


_CACHE_NOW = "2001-07-15 12:00:00"
_CACHED = f"""
cached AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY analysis_date DESC, analysis_id DESC) AS rn FROM analyses
    WHERE analysis_date >= TIMESTAMP '{_CACHE_NOW}' - INTERVAL 720 HOUR AND analysis_version >= '2.0') WHERE rn = 1
)"""


@query("cache_lookup", with_(_ANALYSES, _CACHED) + """
SELECT p.product_id, product_name, c.product_id IS NOT NULL AS used_cache, recommendation,
  CAST(confidence_score AS DOUBLE) AS confidence_score
FROM products p LEFT JOIN cached c ON c.product_id = p.product_id""")
def cache_lookup(spark, sf_dir):
    cached = decide.cached_analyses(analyses(spark, sf_dir), _now(_CACHE_NOW), 720, "2.0")
    return decide.split_by_cache(products(spark, sf_dir), cached).select(
        "product_id", "product_name", "used_cache", "recommendation", "confidence_score"
    )


@query("analysis_history", with_(_ANALYSES) + f"""
SELECT product_id, {stamp('analysis_date')} AS analysis_date, recommendation FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY analysis_date DESC, analysis_id DESC) AS rn FROM analyses)
WHERE rn <= 10""")
def analysis_history(spark, sf_dir):
    rows = decide.analysis_history(analyses(spark, sf_dir))
    return days_as_text(rows.select("product_id", "analysis_date", "recommendation"))


@query("freshness", with_(LISTINGS, CREATED, _CARD_ROWS, CARDS, """
seen AS (SELECT product_id, count(*) AS c, max(created_at) AS last FROM card_rows GROUP BY ALL),
aged AS (SELECT card_id AS product_id, card_name AS product_name, coalesce(c, 0) AS listing_count, last,
  CAST(floor(epoch(TIMESTAMP '2001-08-01' - last) / 86400) AS BIGINT) AS days_old
  FROM cards LEFT JOIN seen ON seen.product_id = card_id)""") + f"""
SELECT product_id, product_name, listing_count, {stamp('last')} AS last_update, days_old, coalesce(days_old <= 60, false) AS is_fresh,
  CASE WHEN days_old <= 60 THEN 'use_cache' WHEN listing_count > 0 AND days_old <= 120 THEN 'scrape_pricecharting_only'
    ELSE 'scrape_both' END AS recommended_action
FROM aged""")
def freshness(spark, sf_dir):
    catalog = views.cards(spark, sf_dir).select(
        F.lit("card").alias("product_type"), F.col("card_id").alias("product_id"), F.col("card_name").alias("product_name")
    )
    rows = decide.freshness(catalog, card_listings(spark, sf_dir, created=True), _now("2001-08-01"), 60)
    return days_as_text(rows.drop("product_type"))


_NAMED = """
named AS (
  SELECT s_name AS query, card_id AS product_id FROM supplier LEFT JOIN cards ON card_id = s_suppkey * 17
)"""


@query("freshness_by_name", with_(LISTINGS, CREATED, _CARD_ROWS, CARDS, _NAMED, """
seen AS (SELECT product_id, count(*) AS c, max(created_at) AS last FROM card_rows GROUP BY ALL),
aged AS (SELECT query, n.product_id, coalesce(c, 0) AS listing_count,
  CAST(floor(epoch(TIMESTAMP '2001-08-01' - last) / 86400) AS BIGINT) AS days_old
  FROM named n LEFT JOIN seen USING (product_id))""") + """
SELECT query, product_id, days_old, CASE WHEN product_id IS NULL THEN 'full_setup' WHEN days_old <= 60 THEN 'use_cache'
  WHEN listing_count > 0 AND days_old <= 120 THEN 'scrape_pricecharting_only' ELSE 'scrape_both' END AS recommended_action
FROM aged""")
def freshness_by_name(spark, sf_dir):
    """Searched names (suppliers play them); a name without a card needs a full setup."""
    cards = views.cards(spark, sf_dir).select(
        F.lit("card").alias("product_type"), F.col("card_id").alias("product_id"), F.col("card_name").alias("product_name"),
        "set_name",
    )
    checked = decide.freshness(cards, card_listings(spark, sf_dir, created=True), _now("2001-08-01"), 60)
    names = views.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("query"), (F.col("s_suppkey") * 17).alias("_id"))
    found = names.join(cards.select("product_type", "product_id"), F.col("_id") == F.col("product_id"), "left").drop("_id")
    return decide.freshness_of_names(found, checked).select("query", "product_id", "days_old", "recommended_action")


@query("stale_products", with_(LISTINGS, CREATED, """
last AS (SELECT product_type, product_id, max(created_at) AS last_data_update FROM created GROUP BY ALL)""") + f"""
SELECT product_type, product_id, {stamp('last_data_update')} AS last_data_update FROM last
WHERE last_data_update < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY ORDER BY last.last_data_update, product_type, product_id LIMIT 20""")
def stale_products(spark, sf_dir):
    rows = views.listings(spark, sf_dir, with_created=True).groupBy("product_type", "product_id").agg(
        F.max("created_at").alias("last_data_update")
    )
    return days_as_text(decide.stale_products(rows, _now("2000-01-01"), 7, 20))


# -- offline preparation -----------------------------------------------------------------------------------

_FEATURES = f"""
unified AS (
  SELECT l.*, c.card_name, c.set_name, c.rarity, c.card_id, n.pc_current_price, n.pc_loose_price, n.pc_graded_price
  FROM listings l JOIN cards c ON c.card_id = l.product_id LEFT JOIN chart_now n ON n.card_id = c.card_id
)"""
_RANK = "CASE rarity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.RARITY_RANKS.items()) + " ELSE 0 END"


def prepared(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    return preparation.prepare(rows, views.cards(spark, sf_dir), views.chart_current(spark, sf_dir), as_of())


@query("unified_features", with_(LISTINGS, CARDS, CHART_NOW, _FEATURES) + f"""
SELECT listing_id, year(sold_date) AS year, month(sold_date) AS month, quarter(sold_date) AS quarter,
  isodow(sold_date) - 1 AS day_of_week, CAST(date_diff('day', sold_date, {NOW}) AS BIGINT) AS days_since_sold,
  {hu('ln(1 + price)', 6)} AS log_price, TRY_CAST(grade AS DOUBLE) AS grade_numeric, {_RANK} AS rarity_rank,
  {hu('price / coalesce(pc_current_price, price)', 6)} AS price_vs_pc_current,
  {hu('(price / pc_current_price - 1) * 100', 6)} AS price_premium_pc,
  {hu('price / coalesce(pc_loose_price, price)', 6)} AS price_vs_pc_loose,
  {hu('price / coalesce(pc_graded_price, price)', 6)} AS price_vs_pc_graded
FROM unified""")
def unified_features(spark, sf_dir):
    rows, _ = prepared(spark, sf_dir)
    rounded = ("log_price", "price_vs_pc_current", "price_premium_pc", "price_vs_pc_loose", "price_vs_pc_graded")
    return rows.select(
        "listing_id", "year", "month", "quarter", "day_of_week", "days_since_sold", "grade_numeric", "rarity_rank",
        *[half_up(F.col(c), 6).alias(c) for c in rounded],
    )


_AGGREGATES = f"""
aggregates AS (
  SELECT card_id, card_name, set_name, count(price) AS price_count, {hu('avg(price)', 2)} AS price_mean,
    {hu('median(price)', 2)} AS price_median, {hu('stddev_samp(price)', 2)} AS price_std, min(price) AS price_min, max(price) AS price_max,
    min(sold_date) AS sold_date_min, max(sold_date) AS sold_date_max, count(*) FILTER (WHERE is_graded) AS is_graded_sum,
    {hu('avg(TRY_CAST(grade AS DOUBLE))', 2)} AS grade_numeric_mean, {hu('any_value(pc_current_price)', 2)} AS pc_current_price_first,
    {hu('any_value(pc_loose_price)', 2)} AS pc_loose_price_first, {hu('any_value(pc_graded_price)', 2)} AS pc_graded_price_first
  FROM unified GROUP BY ALL
)"""
_ALL_FEATURES = (LISTINGS, CARDS, CHART_NOW, _FEATURES, _AGGREGATES)


@query("card_aggregates", with_(*_ALL_FEATURES) + f"""
SELECT * REPLACE ({stamp('sold_date_min')} AS sold_date_min, {stamp('sold_date_max')} AS sold_date_max),
  {hu('price_std / price_mean', 6)} AS price_volatility, {hu('is_graded_sum / price_count * 100', 6)} AS graded_percentage,
  date_diff('day', sold_date_min, sold_date_max) AS date_range_days,
  CASE WHEN price_count <= 0 THEN NULL WHEN price_count <= 5 THEN 'Low' WHEN price_count <= 15 THEN 'Medium'
    WHEN price_count <= 50 THEN 'High' ELSE 'Very High' END AS liquidity
FROM aggregates""")
def card_aggregates(spark, sf_dir):
    return days_as_text(prepared(spark, sf_dir)[1])


@query("top_cards_by_price", with_(*_ALL_FEATURES) + """
SELECT card_id, card_name, price_mean, price_count FROM aggregates ORDER BY price_mean DESC, card_id LIMIT 5""")
def top_cards_by_price(spark, sf_dir):
    return market.top_cards_by_price(prepared(spark, sf_dir)[1]).select("card_id", "card_name", "price_mean", "price_count")


@query("dataset_preview", with_(LISTINGS) + f"""
SELECT min(price) AS min_price, max(price) AS max_price, {hu('avg(price)', 4)} AS avg_price,
  {hu('count(*) FILTER (WHERE is_graded) / count(*) * 100', 4)} AS graded_percentage FROM listings""")
def dataset_preview(spark, sf_dir):
    return market.dataset_preview(views.listings(spark, sf_dir))


def with_cards(spark, sf_dir, *columns):
    cards = views.cards(spark, sf_dir).select(F.col("card_id").alias("product_id"), "card_name", "card_number", "rarity")
    return views.listings(spark, sf_dir).select("product_id", *columns).join(cards, "product_id")


_JOINED = "joined AS (SELECT l.*, c.card_name, c.card_number, c.rarity FROM listings l JOIN cards c ON c.card_id = l.product_id)"


@query("newest_listings", with_(LISTINGS, CREATED, CARDS) + f"""
SELECT listing_id, card_name, rarity, {stamp('created_at')} AS created_at FROM created JOIN cards ON card_id = product_id
ORDER BY created.created_at DESC, listing_id LIMIT 10000""")
def newest_listings(spark, sf_dir):
    rows = preparation.newest_listings(views.listings(spark, sf_dir, with_created=True), views.cards(spark, sf_dir))
    return days_as_text(rows.select("listing_id", "card_name", "rarity", "created_at"))


@query("rarity_distribution", with_(LISTINGS, CARDS, _JOINED) + """
SELECT coalesce(rarity, 'Unknown') AS rarity, count(*) AS listings, count(DISTINCT card_name) AS unique_cards FROM joined GROUP BY ALL""")
def rarity_distribution(spark, sf_dir):
    return audits.rarity_distribution(with_cards(spark, sf_dir))


@query("title_number_counts", with_(LISTINGS, CARDS, _JOINED) + r"""
SELECT card_name, card_number, found_number, count(*) AS times
FROM (SELECT card_name, card_number, unnest(regexp_extract_all(title, '\b\d+/\d+\b')) AS found_number FROM joined) GROUP BY ALL""")
def title_number_counts(spark, sf_dir):
    return audits.title_number_counts(with_cards(spark, sf_dir, "title"))


@query("search_terms_per_card", with_(LISTINGS, CARDS, _JOINED) + """
SELECT card_name, search_terms, count(*) AS listings FROM joined WHERE search_terms <> '' AND card_name <> '' GROUP BY ALL""")
def search_terms_per_card(spark, sf_dir):
    return audits.search_terms_per_card(with_cards(spark, sf_dir, "search_terms"))


