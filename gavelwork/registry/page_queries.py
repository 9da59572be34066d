"""Extraction from pages. The pages are written out of the tables, one per row, so what is
extracted can be compared with the rows themselves."""

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.registry.base import LISTINGS, day, days_as_text, hu, query, quoted, with_
from gavelwork.rules import fixed
from gavelwork.session import scratch_path, spread
from gavelwork.sources import catalog_files, pages
from gavelwork.sources import starviews as views

# -- result pages: one per order with all its items, even orders in the newer layout, odd ones in the older ----


def result_pages(spark, sf_dir):
    order = F.substring_index("listing_id", "-", 1).cast("bigint")
    rows = views.listings(spark, sf_dir).withColumns({"bids": F.month("sold_date"), "order": order})
    price = F.concat(F.lit("$"), F.format_string("%.2f", F.col("price")))
    link = F.concat(F.lit("https://market.example/"), F.col("listing_url"))
    sold = F.date_format("sold_date", "MMM d, yyyy")
    newer = F.concat(
        F.lit('<li class="s-card wide"><div class="s-card__title"><span class="su-styled-text">'),
        F.col("title"), F.lit('</span></div><div class="s-card__caption"><span class="su-styled-text">Sold  '), sold,
        F.lit('</span></div><div class="s-card__subtitle"><span class="su-styled-text">'), F.col("condition"),
        F.lit('</span></div><span class="s-card__price">'), price, F.lit('</span><a class="su-link" href="'), link,
        F.lit('">go</a><div class="s-card__attribute-row">'), F.col("bids").cast("string"),
        F.lit(' bids</div><div class="s-card__attribute-row">+$4.99 delivery</div><img src="i.png"></li>'),
    )
    older = F.concat(
        F.lit('<div class="s-item"><div class="s-item__title"><span>'), F.col("title"),
        F.lit('</span></div><div class="s-item__subtitle"><span class="SECONDARY_INFO">'), F.col("condition"),
        F.lit('</span></div><span class="s-item__price">'), price, F.lit(' to $99,999.00</span><a class="s-item__link" href="'), link,
        F.lit('">go</a><span class="s-item__purchase-options">Buy It Now</span><span class="s-item__shipping">Free shipping</span>'),
        F.lit('<span class="s-item__ended-date">Ended '), sold, F.lit('</span><img data-defer-load="big.png" src="i.png"></div>'),
    )
    even = F.col("order") % 2 == 0
    item = F.struct("listing_id", "price", "sold_date", F.when(even, newer).otherwise(older).alias("html"))
    items = rows.groupBy("order").agg(F.array_join(F.sort_array(F.collect_list(item)).getField("html"), "").alias("items"))  # lines of an order
    html = F.when(even, F.concat(F.lit('<html><body><ul class="srp-results list">'), "items", F.lit("</ul></body></html>"))).otherwise(
        F.concat(F.lit('<html><body><div id="srp-river-results">'), "items", F.lit("</div></body></html>")))
    return items.select(F.col("order").cast("string").alias("url"), html.alias("html"))


_ORDER = "split_part(listing_id, '-', 1)"
_EVEN = f"CAST({_ORDER} AS BIGINT) % 2 = 0"
# in the older layout the title and subtitle of an item have item classes too; they count as places without a title
_PER_ITEM = f"CASE WHEN {_EVEN} THEN 1 ELSE 3 END"


@query("listing_pages", with_(LISTINGS) + f"""
SELECT {_ORDER} AS url, CAST({_PER_ITEM} * (row_number() OVER (PARTITION BY {_ORDER} ORDER BY listing_id, price, sold_date) - 1) AS INTEGER) AS position,
  title, price, 'https://market.example/' || listing_url AS listing_url, condition,
  CASE WHEN {_EVEN} THEN 'i.png' ELSE 'big.png' END AS image_url, {_EVEN} AS is_auction,
  CASE WHEN {_EVEN} THEN month(sold_date) ELSE 0 END AS bids,
  CASE WHEN {_EVEN} THEN '+$4.99 delivery' ELSE 'Free shipping' END AS shipping,
  CASE WHEN {_EVEN} THEN 'Sold  ' ELSE 'Ended ' END || strftime(sold_date, '%b %-d, %Y') AS sold_text,
  regexp_matches(title, {quoted(fixed.GRADE_PATTERN)}) AS is_graded, regexp_extract(title, {quoted(fixed.GRADE_PATTERN)}, 2) AS grade,
  regexp_extract(title, {quoted(fixed.CARD_NUMBER_PATTERN)}, 0) AS card_number
FROM listings""")
def listing_pages(spark, sf_dir):
    return pages.parse_listings(result_pages(spark, sf_dir)).select(
        "url", "position", "title", "price", "listing_url", "condition", "image_url", "is_auction", "bids", "shipping",
        "sold_text", "is_graded", "grade", "card_number",
    )


# -- chart pages ------------------------------------------------------------------------------------------


def point_pages(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    cents = F.round(F.col("price") * 100).cast("bigint").cast("string")
    html = F.concat(
        F.lit("<html><script>VGPC.chart_data = {\"used\":[["), ms, F.lit(","), cents, F.lit("],["), ms, F.lit(",0]]};</script></html>")
    )
    return views.chart_points(spark, sf_dir).select(F.col("point_id").cast("string").alias("url"), html.alias("html"))


@query("chart_points", f"""
SELECT CAST(event_id AS VARCHAR) AS url, 0 AS position, epoch_us(ts) // 1000 AS timestamp_ms, {day('ts')} AS price_date,
  CAST(round(value * 100) AS BIGINT) AS raw_price_cents, {hu('value', 2)} AS price
FROM events WHERE round(value * 100) > 0""")
def chart_points(spark, sf_dir):
    rows = pages.chart_points(point_pages(spark, sf_dir))
    return rows.select(
        "url", "position", "timestamp_ms", F.col("price_date").cast("string").alias("price_date"), "raw_price_cents",
        half_up(F.col("price"), 2).alias("price"),
    )


def array_pages(spark, sf_dir):
    price = F.format_string("%.2f", F.col("price"))
    date = F.date_format("ts", "yyyy-MM-dd")
    listed = F.concat(
        F.lit("<script>var chartData = [[\""), date, F.lit("\", \"\", \"card sale\", \"$"), price,
        F.lit("\", \"Report\"], [\""), date, F.lit("\", \"\", \"Subscribe now\", \"$7\", \"\"], [\"soon\", \"\", \"card\", \"$8\"], [\"x\"]];</script>"),
    )
    keyed = F.concat(
        F.lit("<script>var series = {\"data\": [{\"date\": \""), date, F.lit("\", \"price\": \"$"), price,
        F.lit("\"}, {\"date\": \""), date, F.lit("\", \"price\": \"6\"}]}</script>"),
    )
    even = F.col("point_id") % 2 == 0
    return views.chart_points(spark, sf_dir).select(
        F.col("point_id").cast("string").alias("url"), F.when(even, listed).otherwise(keyed).alias("html")
    )


@query("chart_arrays", f"""
SELECT CAST(event_id AS VARCHAR) AS url, 0 AS position, {day('ts')} AS date, CAST(printf('%.2f', value) AS DOUBLE) AS price,
  CASE WHEN event_id % 2 = 0 THEN 'card sale' END AS description
FROM events WHERE value BETWEEN 1 AND 100000 AND value <> 6.0""")
def chart_arrays(spark, sf_dir):
    return pages.chart_arrays(array_pages(spark, sf_dir))


@query("mixed_history", f"""
SELECT CASE WHEN event_id % 7 <> 0 THEN 'card-' || user_id END AS product_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN {day('ts')} END AS price_date,
  CASE WHEN event_id % 7 <> 0 THEN round(value, 2) END AS price
FROM events""")
def mixed_history(spark, sf_dir):
    """Chart dumps landed as lines with both shapes of points, undated points and broken lines, read back."""
    key, path = F.col("event_id"), scratch_path(spark, "history")
    date = F.when(key % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    price = F.format_string("%.2f", "value")
    point = F.when(key % 2 == 0, F.concat(F.lit('["'), date, F.lit('", "sale", '), price, F.lit("]"))).otherwise(
        F.concat(F.lit('{"price": '), price, F.lit(', "date": "'), date, F.lit('"}')))
    line = F.concat(F.lit('{"card_id": "card-'), F.col("user_id"), F.lit('", "historical_chart_data": ['), point, F.when(key % 7 == 0, "").otherwise("]}"))
    views.read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return days_as_text(catalog_files.mixed_history(spark, path))


# -- tables, prices by condition, details: one page per part -------------------------------------------------


def product_pages(spark, sf_dir):
    def part_of(share):
        cents = F.expr(f"CAST(round(p_retailprice * 100) AS BIGINT) DIV {share}")
        return F.format_string("%.2f", cents / 100)

    price, low = part_of(10), part_of(20)
    date = F.concat(F.lit("2023-05-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))
    html = F.concat(
        F.lit("<html><h1> "), F.col("p_name"), F.lit(' </h1><div class="product-detail">Brand: '), F.col("p_brand"),
        F.lit('</div><div class="product-detail">Size:'), F.col("p_size").cast("string"), F.lit("</div>"),
        F.lit('<table class="price-summary"><tr><th>Ungraded</th><td>$'), low, F.lit("</td></tr><tr><th>PSA 10</th><td>$"), price,
        F.lit("</td></tr><tr><th>Fee</th><td>$6</td></tr></table>"),
        F.lit("<table><tr><th>Date</th><th>Title</th><th>Price</th></tr><tr><td>"), date, F.lit("</td><td>pokemon card "), F.col("p_name"),
        F.lit('</td><td class="numeric">$'), price, F.lit("</td></tr><tr><td>soon</td><td>nothing of note</td><td>$12.34</td></tr></table>"),
        F.lit('<p>loose <span class="price">$'), low, F.lit('</span></p><div><div class="current-price">$'), price,
        F.lit('</div></div><div class="tour-box"><div class="chart-price">$77.70</div></div></html>'),
    )
    parts = spread(views.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"))
    return parts.select(F.col("p_partkey").cast("string").alias("url"), html.alias("html"))


_PRICE = "(CAST(round(p_retailprice * 100) AS BIGINT) // 10 / 100.0)"
_HALF = "(CAST(round(p_retailprice * 100) AS BIGINT) // 20 / 100.0)"
_DATE = "'2023-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0')"
_STRICT = " AND {0} BETWEEN 1 AND 100000 AND {0} NOT IN (" + ", ".join(str(p) for p in fixed.NON_PRODUCT_PRICES) + ")"


@query("page_tables", f"""
SELECT CAST(p_partkey AS VARCHAR) AS url, 1 AS table_index, 1 AS row_index, {_DATE} AS date, {_PRICE} AS price
FROM part WHERE {_PRICE} BETWEEN 1 AND 100000 AND {_PRICE} <> 6.0""")
def page_tables(spark, sf_dir):
    rows = pages.table_prices(pages.page_tables(product_pages(spark, sf_dir)))
    return rows.select("url", "table_index", "row_index", "date", "price")


@query("sales_tables", f"""
SELECT CAST(p_partkey AS VARCHAR) AS url, {_DATE} AS date, {_PRICE} AS price, 'pokemon card ' || p_name AS description
FROM part WHERE true{_STRICT.format(_PRICE)}""")
def sales_tables(spark, sf_dir):
    rows = pages.sales_table_prices(pages.page_tables(product_pages(spark, sf_dir)))
    return rows.select("url", "date", "price", "description")


@query("summary_prices", f"""
SELECT CAST(p_partkey AS VARCHAR) AS url, 'ungraded' AS condition, {_HALF} AS price FROM part WHERE true{_STRICT.format(_HALF)}
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'psa_10', {_PRICE} FROM part WHERE true{_STRICT.format(_PRICE)}""")
def summary_prices(spark, sf_dir):
    return pages.summary_prices(pages.page_tables(product_pages(spark, sf_dir)))


# The chart price sits in a tour area, which only the strict reading leaves out. The plain
# reading takes the last price of each condition: the tour price for the current one.
@query("current_prices", f"""
SELECT CAST(p_partkey AS VARCHAR) AS url, 'loose' AS condition, {_HALF} AS price FROM part WHERE {_HALF} BETWEEN 1 AND 100000 AND {_HALF} <> 6.0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'current', 77.7::DOUBLE FROM part""")
def current_prices(spark, sf_dir):
    return pages.current_prices(product_pages(spark, sf_dir))


@query("display_prices", f"""
SELECT CAST(p_partkey AS VARCHAR) AS url, 'display_current' AS condition, {_PRICE} AS price FROM part WHERE true{_STRICT.format(_PRICE)}""")
def display_prices(spark, sf_dir):
    return pages.display_prices(product_pages(spark, sf_dir))


@query("product_details", """
SELECT CAST(p_partkey AS VARCHAR) AS url, p_name AS title, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 2 AS details FROM part""")
def product_details(spark, sf_dir):
    rows = pages.product_details(product_pages(spark, sf_dir))
    return rows.select(
        "url", "title", F.col("details")["brand"].alias("brand"), F.col("details")["size"].alias("size"),
        F.size("details").alias("details"),
    )


@query("raw_page_scan", """
SELECT count(*) AS pages, count(*) FILTER (WHERE regexp_matches(html, '\\[(\\d{13}),(\\d+)\\]')) AS with_points,
  count(*) FILTER (WHERE contains(html, '<table')) AS with_tables FROM pages""")
def raw_page_scan(spark, sf_dir):
    landed = views.read(spark, sf_dir, "pages")
    return landed.agg(
        F.count("*").alias("pages"), F.count_if(F.col("html").rlike(r"\[(\d{13}),(\d+)\]")).alias("with_points"),
        F.count_if(F.col("html").contains("<table")).alias("with_tables"),
    )


@query("landed_page_titles", """
SELECT url, coalesce(trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), '') <> '' AS has_heading FROM pages""")
def landed_page_titles(spark, sf_dir):
    return pages.product_details(views.read(spark, sf_dir, "pages")).select(
        "url", (F.coalesce("title", F.lit("")) != "").alias("has_heading")
    )
