"""Market summaries, premiums, liquidity, insights and listing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up, ratio
from gavelwork.functions.text import liquidity_level
from gavelwork.operators.histogram import weighted_mean, weighted_median

STRATEGIES = (("raw", "raw_nm"), ("psa9", "psa_9"), ("psa10", "psa_10"))


def sold_since(as_of: Column, days: int) -> Column:
    return F.col("sold_date") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def market_summary(listings: DataFrame, as_of: Column) -> DataFrame:
    """Per card: overall and per-strategy price statistics, premiums, liquidity.

    All numbers come from one histogram (card, strategy, price): counts, exact sums and
    medians are read off value counts, so a card with a third of all listings costs its
    last task no more than its number of different prices.
    """
    return summary_of_counts(listings.withColumn("n_rows", F.lit(1)), as_of)


def summary_of_counts(counted: DataFrame, as_of: Column) -> DataFrame:
    """``market_summary`` of listings that are counted (``n_rows``) by product, strategy, sale date and price."""
    recent = sold_since(as_of, 30)
    counts = counted.groupBy("product_id", "search_strategy", "price").agg(
        F.sum("n_rows").alias("n_rows"), F.coalesce(F.sum(F.when(recent, F.col("n_rows"))), F.lit(0)).alias("n_recent")
    )
    price = F.col("price")
    positive = F.when(price > 0, price)
    rows = F.col("n_rows")
    columns = [
        F.sum("n_rows").alias("total_listings"),
        F.coalesce(weighted_mean(positive, F.when(price > 0, rows)), F.lit(0.0)).alias("avg_price"),
        F.coalesce(F.min(positive).cast("double"), F.lit(0.0)).alias("lowest_price"),
        F.coalesce(F.max(positive).cast("double"), F.lit(0.0)).alias("highest_price"),
        F.sum("n_recent").alias("recent_sales"),
    ]
    for name, strategy in STRATEGIES:
        of = F.col("search_strategy") == strategy
        p, n = F.when(of, positive), F.when(of & (price > 0), rows)
        columns += [
            F.coalesce(F.sum(F.when(of, rows)), F.lit(0)).alias(f"{name}_sold_count"),
            half_up(F.coalesce(weighted_mean(p, n), F.lit(0.0)), 2).alias(f"{name}_avg_price"),
            half_up(F.coalesce(weighted_median(p, n), F.lit(0.0)), 2).alias(f"{name}_median_price"),
            half_up(F.coalesce(F.min(p), F.lit(0)), 2).alias(f"{name}_lowest_price"),
            half_up(F.coalesce(F.max(p), F.lit(0)), 2).alias(f"{name}_highest_price"),
        ]
    summary = counts.groupBy("product_id").agg(*columns)
    return (
        summary.withColumn("grading_premium_psa9", premium("psa9"))
        .withColumn("grading_premium_psa10", premium("psa10"))
        .withColumn("market_liquidity", liquidity_level(F.col("recent_sales")))
    )


def premium(graded: str) -> Column:
    """Percent by which the graded mean exceeds the raw mean; 0 when either is missing."""
    raw, top = F.col("raw_avg_price"), F.col(f"{graded}_avg_price")
    return half_up(
        F.when((raw > 0) & (top > 0), (ratio(top, raw) - 1) * 100).otherwise(0.0), 2
    )


def liquidity(listings: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Recent sales and liquidity level per product."""
    return (
        listings.groupBy("product_id")
        .agg(F.count_if(sold_since(as_of, days)).alias("recent_sales"))
        .withColumn("market_liquidity", liquidity_level(F.col("recent_sales")))
    )


def valid_summaries(summaries: DataFrame, least: int = 3) -> DataFrame:
    return summaries.filter(F.col("total_listings") >= least)


def top_insights(summaries: DataFrame, limit: int = 20) -> DataFrame:
    """Four top lists in one table: cheapest raw cards, highest premiums, most listings.

    The summaries are read once: every row offers itself to the lists it qualifies for,
    and the rank limit keeps ``limit`` rows per list and input task before the shuffle.
    Ties go to the smaller card id. Each row tells the prices behind its list: raw and graded
    means, and the mean of all listings.
    """
    raw, p10, p9 = F.col("raw_avg_price"), F.col("grading_premium_psa10"), F.col("grading_premium_psa9")
    n = F.col("total_listings").cast("double")

    def offer(test: Column, kind: str, value: Column, key: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("insight"), value.alias("value"), key.alias("sort_key")))

    offers = F.array_compact(F.array(
        offer(raw > 0, "top_value_raw_cards", raw, raw),
        offer(p10 > 0, "highest_psa10_premiums", p10, -p10),
        offer(p9 > 0, "highest_psa9_premiums", p9, -p9),
        offer(F.lit(True), "most_liquid_markets", n, -n),
    ))
    prices = ("raw_avg_price", "psa9_avg_price", "psa10_avg_price", "avg_price")
    best = Window.partitionBy("insight").orderBy("sort_key", "product_id")
    return (
        valid_summaries(summaries)
        .select("product_id", *prices, "total_listings", "market_liquidity", F.explode(offers).alias("_o"))
        .select("*", "_o.*")
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= limit)
        .select("insight", "position", "product_id", "value", *prices, "total_listings", "market_liquidity")
    )


def market_overview(summaries: DataFrame) -> DataFrame:
    """Totals, listings per card, mean positive premiums, cards per liquidity level."""
    valid = valid_summaries(summaries)
    p9 = F.when(F.col("grading_premium_psa9") > 0, F.col("grading_premium_psa9"))
    p10 = F.when(F.col("grading_premium_psa10") > 0, F.col("grading_premium_psa10"))
    level = F.col("market_liquidity")
    return valid.agg(
        F.count("*").alias("total_cards"),
        F.coalesce(F.sum("total_listings"), F.lit(0)).alias("total_listings"),
        half_up(F.coalesce(ratio(F.sum("total_listings"), F.count("*")), F.lit(0.0)), 1).alias("avg_listings_per_card"),
        half_up(F.coalesce(F.avg(p9), F.lit(0.0)), 2).alias("avg_psa9_premium"),
        half_up(F.coalesce(F.avg(p10), F.lit(0.0)), 2).alias("avg_psa10_premium"),
        F.count_if(level == "high").alias("high_liquidity"),
        F.count_if(level == "medium").alias("medium_liquidity"),
        F.count_if(level == "low").alias("low_liquidity"),
    )


def simple_summary(listings: DataFrame) -> DataFrame:
    """Mean, range and count per card, with means of graded and raw listings.

    Cards without a positive price are left out.
    """
    price = F.when(F.col("price") > 0, F.col("price"))
    graded = F.coalesce(F.col("is_graded"), F.lit(False))
    g, r = F.when(graded, price), F.when(~graded, price)
    return (
        listings.groupBy("product_id")
        .agg(
            half_up(F.avg(price), 4).alias("avg_price"),
            F.min(price).cast("double").alias("lowest_price"),
            F.max(price).cast("double").alias("highest_price"),
            F.count("*").alias("total_sales"),
            half_up(F.avg(g), 4).alias("avg_graded_price"),
            F.count(g).alias("graded_sales_count"),
            half_up(F.avg(r), 4).alias("avg_raw_price"),
            F.count(r).alias("raw_sales_count"),
        )
        .filter(F.col("avg_price").isNotNull())
    )


def price_summary(listings: DataFrame, as_of: Column) -> DataFrame:
    """Mean, range, sales and last-30-day sales of every product (card or sealed)."""
    return listings.groupBy("product_type", "product_id").agg(
        half_up(F.avg("price"), 4).alias("avg_price"),
        F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
        F.count("*").alias("total_sales"),
        F.count_if(sold_since(as_of, 30)).alias("recent_sales"),
    )


def sealed_market_summary(listings: DataFrame, trends: DataFrame, as_of: Column, flat_pct: float = 5.0) -> DataFrame:
    """Price summary of sealed products with the trend of their series.

    ``trends`` comes from ``metrics.trend_thirds``; a change of at most ``flat_pct``
    percent counts as stable.
    """
    summary = price_summary(listings.filter(F.col("product_type") == "sealed"), as_of)
    trend = trends.select(
        F.col("product_id").alias("_key"),
        F.when(F.col("trend_strength") <= flat_pct, "stable").otherwise(F.col("trend_direction")).alias("price_trend"),
    )
    key = F.concat_ws("-", F.lit("sealed"), F.col("product_id").cast("string"))
    return summary.join(trend, key == F.col("_key"), "left").select(
        F.col("product_id").alias("sealed_product_id"),
        "avg_price",
        F.col("min_price").alias("lowest_price"),
        F.col("max_price").alias("highest_price"),
        "total_sales",
        F.col("recent_sales").alias("sales_last_30_days"),
        F.coalesce("price_trend", F.lit("stable")).alias("price_trend"),
    )


def upload_statistics(listings: DataFrame, as_of: Column) -> DataFrame:
    """Total rows, distinct products, rows since midnight, mean rows per product.

    Grouped by product first, so the distinct count needs no expansion of the rows.
    """
    today = F.date_trunc("day", as_of)
    per_card = listings.groupBy("product_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("created_at") >= today).alias("_today")
    )
    return per_card.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_listings"),
        F.count("*").alias("unique_cards_tracked"),
        F.coalesce(F.sum("_today"), F.lit(0)).alias("uploads_since_midnight"),
        half_up(F.coalesce(ratio(F.sum("_n"), F.count("*")), F.lit(0.0)), 4).alias("avg_listings_per_card"),
    )


def collection_summary(listings: DataFrame) -> DataFrame:
    """Rows by condition and by search strategy, as (breakdown, value, rows).

    One pass: the rows are counted by both columns, then each breakdown sums the counts.
    """
    counts = listings.groupBy("condition_category", "search_strategy").agg(
        F.count("*").alias("_n"), F.count_if(F.col("price") > 0).alias("_priced")
    )
    pair = F.array(
        F.struct(F.lit("condition").alias("breakdown"), F.col("condition_category").alias("value")),
        F.struct(F.lit("search_strategy").alias("breakdown"), F.col("search_strategy").alias("value")),
    )
    return (
        counts.select(F.explode(pair).alias("_p"), "_n", "_priced")
        .groupBy("_p.breakdown", "_p.value")
        .agg(F.sum("_n").alias("listings"), F.sum("_priced").alias("listings_with_prices"))
    )


def coverage(catalog: DataFrame, listings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Catalog entries with and without listings, share complete, touched lately."""
    seen = listings.groupBy(F.col("product_id").alias("card_id")).agg(F.max("created_at").alias("_last"))
    cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    counts = catalog.select("card_id").join(seen, "card_id", "left").agg(
        F.count("*").alias("total_cards"),
        F.count("_last").alias("cards_with_listings"),
        F.count_if(F.col("_last") >= cutoff).alias("cards_updated_recently"),
    )
    total, have = F.col("total_cards"), F.col("cards_with_listings")
    return counts.select(
        total, have, (total - have).alias("cards_never_listed"),
        half_up(F.coalesce(ratio(have, total), F.lit(0.0)) * 100, 4).alias("completion_percentage"),
        "cards_updated_recently",
    )


def stale_cards(catalog: DataFrame, listings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Cards never listed, or last listed before the cutoff, with whole days since."""
    last = listings.groupBy(F.col("product_id").alias("card_id")).agg(F.max("created_at").alias("last_update"))
    cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    since = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_update")) / 86400).cast("bigint")
    return (
        catalog.join(last, "card_id", "left")
        .filter(F.col("last_update").isNull() | (F.col("last_update") < cutoff))
        .withColumn("days_since_update", since)
    )


def listing_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("product_type", "product_id").agg(F.count("*").alias("listings"))


def recent_listings(listings: DataFrame, limit: int = 10) -> DataFrame:
    """Newest rows of every product, at most ``limit`` each."""
    newest = Window.partitionBy("product_type", "product_id").orderBy(F.desc("created_at"), "listing_id")
    return listings.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= limit)


def recent_sales(listings: DataFrame, as_of: Column, days: int = 30, product_id=None) -> DataFrame:
    """Sales of the last ``days`` days, newest first; of one product when given."""
    rows = listings.filter(sold_since(as_of, days))
    if product_id is not None:
        rows = rows.filter(F.col("product_id") == product_id)
    return rows.select("product_id", "listing_id", "title", "price", "sold_date", "condition").orderBy(
        F.desc("sold_date"), "listing_id"
    )


def all_listings(card_listings: DataFrame, sealed_listings: DataFrame, cards: DataFrame, sealed: DataFrame) -> DataFrame:
    """Card and sealed listings in one shape: type tag, text id, product description.

    Missing name parts are skipped in the description.
    """
    shared = [
        "listing_id", "title", "price", "condition", "sold_date", "listing_url", "search_terms",
        "condition_category", "search_strategy", "grade_numeric",
    ]

    def part(rows: DataFrame, kind: str, catalog: DataFrame, key: str, description: Column) -> DataFrame:
        named = catalog.select(F.col(key).alias("product_id"), description.alias("product_description"))
        return (
            rows.filter(F.col("product_id").isNotNull())
            .join(named, "product_id", "left")
            .select(
                F.lit(kind).alias("listing_type"), *shared,
                F.col("product_id").cast("string").alias("product_id"), "product_description",
            )
        )

    blank = F.lit("")
    card_text = F.concat(F.coalesce("card_name", blank), F.lit(" - "), F.coalesce("set_name", blank))
    sealed_text = F.concat(
        F.coalesce("product_name", blank), F.lit(" ("), F.coalesce("product_type", blank), F.lit(")")
    )
    return part(card_listings, "card", cards, "card_id", card_text).unionByName(
        part(sealed_listings, "sealed", sealed, "sealed_product_id", sealed_text)
    )


def listing_type_profile(listings: DataFrame) -> DataFrame:
    """Count, mean and range per listing type."""
    return listings.groupBy("listing_type").agg(
        F.count("*").alias("listing_count"),
        half_up(F.avg("price"), 4).alias("avg_price"),
        F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
    )


def product_summary(products: DataFrame, series: DataFrame, latest_analyses: DataFrame) -> DataFrame:
    """Products with their series statistics and latest analysis; both may be missing."""
    points = series.groupBy("product_id").agg(
        F.count("*").alias("total_price_points"),
        F.min("price_date").alias("earliest_price_date"),
        F.max("price_date").alias("latest_price_date"),
        half_up(F.avg("price"), 4).alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    latest = latest_analyses.select(
        "product_id",
        F.col("recommendation").alias("latest_recommendation"),
        F.col("confidence_score").alias("latest_confidence"),
        F.col("analysis_date").alias("latest_analysis_date"),
    )
    return (
        products.join(points, "product_id", "left")
        .join(latest, "product_id", "left")
        .withColumn("total_price_points", F.coalesce("total_price_points", F.lit(0)))
    )


def latest_analyses(analyses: DataFrame, products: DataFrame) -> DataFrame:
    """The newest analysis of every product, with the product's names."""
    from gavelwork.operators.decide import latest_per_key

    return latest_per_key(analyses, ["product_id"], "analysis_date").join(
        products.select("product_id", "product_name", "set_name", "product_type"), "product_id"
    )


# -- offline preparation ---------------------------------------------------------------------


def card_aggregates(rows: DataFrame) -> DataFrame:
    """Per-card price and date statistics, graded share, volatility, liquidity class.

    Rows without a card key are dropped. Means and medians come from the (card, price)
    histogram; the deviation is summed around the mean of the card, so that large prices
    with a small spread keep it. The first chart price is the one any row carries.
    """
    keys = ["card_id", "card_name", "set_name"]
    known = rows.filter(F.col("card_id").isNotNull() & F.col("card_name").isNotNull() & F.col("set_name").isNotNull())
    counts = known.groupBy(*keys, "price").agg(
        F.count("price").alias("n_rows"),
        F.min("sold_date").alias("_first"), F.max("sold_date").alias("_last"),
        F.count_if(F.col("is_graded")).alias("_graded"),
        F.sum("grade_numeric").alias("_grade_sum"), F.count("grade_numeric").alias("_grade_n"),
        *[F.any_value(c, True).alias(c) for c in ("pc_current_price", "pc_loose_price", "pc_graded_price")],
    )
    price, n = F.col("price").cast("double"), F.col("n_rows")
    card = Window.partitionBy(*keys)  # deals the rows as the aggregate needs them
    centred = counts.withColumn("_centre", F.try_divide(F.sum(price * n).over(card), F.sum(n).over(card)))
    off = price - F.col("_centre")
    sums = centred.groupBy(*keys).agg(
        F.sum("n_rows").alias("price_count"),
        weighted_mean(F.col("price"), n).alias("_mean"),
        weighted_median(F.col("price"), n).alias("_median"),
        F.sum(off * off * n).alias("_square"),
        F.min(price).alias("price_min"), F.max(price).alias("price_max"),
        F.min("_first").alias("sold_date_min"), F.max("_last").alias("sold_date_max"),
        F.sum("_graded").alias("is_graded_sum"),
        half_up(ratio(F.sum("_grade_sum"), F.sum("_grade_n")), 2).alias("grade_numeric_mean"),
        *[half_up(F.any_value(c, True), 2).alias(f"{c}_first")
          for c in ("pc_current_price", "pc_loose_price", "pc_graded_price")],
    )
    spread = F.sqrt(F.try_divide(F.col("_square"), F.col("price_count") - 1))
    count = F.col("price_count")
    return (
        sums.withColumn("price_mean", half_up(F.col("_mean"), 2))
        .withColumn("price_median", half_up(F.col("_median"), 2))
        .withColumn("price_std", half_up(spread, 2))
        .withColumn("price_volatility", half_up(ratio(F.col("price_std"), F.col("price_mean")), 6))
        .withColumn("graded_percentage", half_up(ratio(F.col("is_graded_sum"), count) * 100, 6))
        .withColumn("date_range_days", F.datediff("sold_date_max", "sold_date_min").cast("bigint"))
        .withColumn(
            "liquidity",
            F.when((count > 0) & (count <= 5), "Low").when((count > 5) & (count <= 15), "Medium")
            .when((count > 15) & (count <= 50), "High").when(count > 50, "Very High"),
        )
        .drop("_mean", "_median", "_square")
    )


def dataset_preview(rows: DataFrame) -> DataFrame:
    """Price range and mean, share of graded rows."""
    return rows.agg(
        F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
        half_up(F.avg("price"), 4).alias("avg_price"),
        half_up(ratio(F.count_if(F.col("is_graded")), F.count("*")) * 100, 4).alias("graded_percentage"),
    )


def top_cards_by_price(aggregates: DataFrame, limit: int = 5) -> DataFrame:
    return aggregates.orderBy(F.desc("price_mean"), "card_id").limit(limit)

