"""Audits of listings and series: suspicious rows, categories, buckets, ranges, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.functions.numbers import half_up, ratio
from gavelwork.operators.histogram import exclusive_quartiles, price_histogram, weighted_mean, weighted_median
from gavelwork.operators.quality import join_groups
from gavelwork.rules import fixed


def low_prices(listings: DataFrame, below: float = 10, limit: int = 20) -> DataFrame:
    """The cheapest listings below a price, cheapest first."""
    return listings.filter(F.col("price") < below).orderBy("price", "listing_id").limit(limit)


def range_audit(series: DataFrame) -> DataFrame:
    """Count, range, mean, rows below 50 and above 1000, share outside 25-2000."""
    p = F.col("price")
    odd = F.count_if((p < 25) | (p > 2000))
    return series.agg(
        F.count("*").alias("total_points"),
        F.min(p).cast("double").alias("min_price"),
        F.max(p).cast("double").alias("max_price"),
        half_up(F.avg(p), 4).alias("avg_price"),
        F.count_if(p < 50).alias("below_50"),
        F.count_if(p > 1000).alias("above_1000"),
        odd.alias("unrealistic_count"),
        half_up(F.coalesce(ratio(odd, F.count("*")), F.lit(0.0)) * 100, 4).alias("unrealistic_pct"),
    )


def suspicions() -> Column:
    """Reasons to doubt a listing: low price for a box, empty-box words, damage words."""
    low = F.lower("title")
    box = (F.col("product_type") == "sealed") & F.lower("product_name").contains("booster box")
    return F.array_compact(F.array(
        F.when(box & (F.col("price") < 50), "Suspiciously low for booster box"),
        F.when(text.any_contains(low, fixed.EMPTY_BOX_WORDS), "Likely empty box"),
        F.when(text.any_contains(low, fixed.DAMAGE_WORDS), "Likely damaged/opened"),
    ))


def suspicious_listings(listings: DataFrame) -> DataFrame:
    """One row per listing and reason."""
    return listings.withColumn("reason", F.explode(suspicions()))


def product_audit(listings: DataFrame, keys: Sequence[str], min_group: int = 3) -> DataFrame:
    """Per product: name, lowest price, suspicions and price outliers within its groups (``keys``).

    The listings are read and shuffled once, as counts by group and price; outlier limits and all three
    numbers are read off those.
    """
    keys = list(keys)
    counts = listings.groupBy(*keys, "price").agg(
        F.count("*").alias("n_rows"), F.sum(F.size(suspicions())).alias("doubts"), F.min("product_name").alias("product_name"))
    limits = exclusive_quartiles(counts, keys).filter(F.col("n_total") >= min_group).select(*keys, "q1", "q3")
    spread, p = F.col("q3") - F.col("q1"), F.col("price").cast("double")
    out = (p < F.col("q1") - 1.5 * spread) | (p > F.col("q3") + 1.5 * spread)
    return join_groups(counts, limits, keys, "left").groupBy("product_type", "product_id").agg(
        F.min("product_name").alias("product_name"), F.min("price").alias("min_price"), F.sum("doubts").alias("suspicious_count"),
        F.coalesce(F.sum(F.when(out, F.col("n_rows"))), F.lit(0)).alias("outlier_count"),
    )


def suspicious_counts(listings: DataFrame) -> DataFrame:
    """Suspicious rows per product and reason."""
    return suspicious_listings(listings).groupBy("product_type", "product_id", "reason").agg(
        F.count("*").alias("listings"), F.min("price").cast("double").alias("lowest_price")
    )


def wrongly_removed(filtered: DataFrame) -> DataFrame:
    """Title removals that name a booster box at a usual price."""
    return filtered.filter(
        (F.col("removed_by") == "title_pattern")
        & F.lower("title").contains("booster box")
        & F.col("price").between(50, 500)
    )


def removal_patterns(filtered: DataFrame) -> DataFrame:
    """Overlapping counts of four patterns among the title removals."""
    low = F.lower("title")
    return filtered.filter(F.col("removed_by") == "title_pattern").agg(
        F.count("*").alias("title_removed"),
        F.count_if(low.contains("pack") & ~low.contains("box")).alias("single_pack"),
        F.count_if(low.contains("blister")).alias("blister"),
        F.count_if(text.any_contains(low, ("empty", "damaged", "opened"))).alias("damaged"),
        F.count_if(text.any_contains(low, ("4 pack", "8 pack", "12 pack"))).alias("multi_pack"),
    )


def listing_category(title: Column, wanted_set: str = "brilliant stars",
                     other_sets: Sequence[str] = fixed.CATEGORY_OTHER_SETS) -> Column:
    """First of eight categories a title falls into."""
    low = F.lower(title)
    box = low.contains("booster box")
    small = low.rlike(r"\b(?:1|2|3|4|5|6|7|8|9|10|11|12)\s*pack[s]?\b")
    return (
        F.when(text.any_contains(low, ("empty", "box only", "damaged", "opened")), "damaged_empty")
        .when(text.any_contains(low, ("etb", "elite trainer")), "elite_trainer_boxes")
        .when(low.contains("blister"), "blister_packs")
        .when(small & ~box, "small_bundles")
        .when(text.any_contains(low, ("booster pack", "single pack")) & ~box, "single_packs")
        .when(box | (low.contains("36") & (low.contains("pack") | low.contains("box"))), "actual_booster_boxes")
        .when(text.any_contains(low, other_sets) & ~low.contains(wanted_set), "wrong_set")
        .otherwise("other_products")
    )


CATEGORY_CLASSES = {
    "actual_booster_boxes": "keep",
    "single_packs": "filter", "blister_packs": "filter", "damaged_empty": "filter", "wrong_set": "filter",
    "elite_trainer_boxes": "questionable", "small_bundles": "questionable", "other_products": "questionable",
}


def category_profile(listings: DataFrame, **rules) -> DataFrame:
    """Count, price range and mean per category, with its keep / filter class."""
    rows = listings.withColumn("category", listing_category(F.col("title"), **rules))
    return (
        rows.groupBy("category")
        .agg(
            F.count("*").alias("listings"),
            F.min("price").cast("double").alias("min_price"),
            F.max("price").cast("double").alias("max_price"),
            half_up(F.avg("price"), 4).alias("avg_price"),
        )
        .withColumn("filter_class", text.lookup(F.col("category"), CATEGORY_CLASSES))
    )


def filter_rates(profile: DataFrame) -> DataFrame:
    """Listings per keep / filter / questionable class and the rate that should go."""
    def rows(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("filter_class") == kind, F.col("listings"))), F.lit(0))

    return profile.agg(
        F.sum("listings").alias("total_listings"),
        rows("keep").alias("should_keep"),
        rows("filter").alias("should_filter"),
        rows("questionable").alias("questionable"),
        half_up(ratio(rows("filter"), F.sum("listings")) * 100, 4).alias("should_filter_pct"),
    )


def price_buckets(listings: DataFrame) -> DataFrame:
    """Listings per price bucket and rarity."""
    p = F.col("price")
    bucket = (
        F.when(p < 5, "Under $5").when(p < 10, "$5-$10").when(p < 25, "$10-$25").when(p < 50, "$25-$50")
        .otherwise("$50+")
    )
    return listings.groupBy(bucket.alias("price_range"), "rarity").agg(F.count("*").alias("listings"))


def price_distribution(listings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Range, mean, upper median and overlapping shares; from the price histogram.

    The upper median is the value at position n // 2 of the sorted prices.
    """
    keys = list(keys)
    counts = price_histogram(listings, keys)
    p, n = F.col("price"), F.col("n_rows")
    # cumulative counts per key: as many rows as there are different prices
    upto = F.sum("n_rows").over(
        Window.partitionBy(*(keys or [F.lit(1)])).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = F.sum("n_rows").over(Window.partitionBy(*(keys or [F.lit(1)])))
    ranked = counts.withColumn("_upto", upto).withColumn("_total", whole)
    middle = F.floor(F.col("_total") / 2)
    at_middle = (F.col("_upto") > middle) & (F.col("_upto") - n <= middle)

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    def pct(test: Column, name: str) -> Column:
        return half_up(ratio(rows(test), F.sum("n_rows")) * 100, 4).alias(name)

    return ranked.groupBy(*keys).agg(
        F.sum("n_rows").alias("listings"),
        F.min(p).cast("double").alias("min_price"),
        F.max(p).cast("double").alias("max_price"),
        half_up(weighted_mean(p, n), 4).alias("avg_price"),
        F.max(F.when(at_middle, p)).cast("double").alias("upper_median"),
        pct(p < 50, "under_50_pct"),
        pct(p < 75, "under_75_pct"),
        pct(p > 200, "over_200_pct"),
        pct(p > 500, "over_500_pct"),
    )


def series_outlier_audit(series: DataFrame, keys: Sequence[str] = ("product_id", "source", "condition_category"),
                         min_group: int = 3) -> DataFrame:
    """Per group: count, range, median, moderate and extreme outliers.

    Read off the price histogram alone; the series rows are not joined again. NULL in a key
    is a value of its own.
    """
    keys = list(keys)
    counts = price_histogram(series, keys)
    limits = exclusive_quartiles(counts, keys).filter(F.col("n_total") >= min_group)
    spread = F.col("q3") - F.col("q1")
    p, n = F.col("price").cast("double"), F.col("n_rows")
    far = (p < F.col("q1") - 3 * spread) | (p > F.col("q3") + 3 * spread)
    out = (p < F.col("q1") - 1.5 * spread) | (p > F.col("q3") + 1.5 * spread)

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    return join_groups(counts, limits.drop("min_price", "max_price"), keys, "inner").groupBy(*keys).agg(
        F.sum("n_rows").alias("points"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        half_up(F.max("median"), 4).alias("median_price"),
        rows(out).alias("outliers"),
        rows(far).alias("extreme_outliers"),
    )


def series_statistics(series: DataFrame) -> DataFrame:
    """Count, range, mean and median of the whole series table."""
    counts = price_histogram(series, [])
    p, n = F.col("price").cast("double"), F.col("n_rows")
    return counts.agg(
        F.sum("n_rows").alias("total_points"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        half_up(weighted_mean(F.col("price"), n), 2).alias("mean_price"),
        half_up(weighted_median(p, n), 2).alias("median_price"),
    )


def rarity_distribution(listings: DataFrame) -> DataFrame:
    """Listings and distinct cards per rarity, most frequent first.

    Counted per card first; the distinct count is then a plain count of groups.
    """
    per_card = listings.groupBy("rarity", "card_name").agg(F.count("*").alias("_n"))
    return per_card.groupBy(F.coalesce("rarity", F.lit("Unknown")).alias("rarity")).agg(
        F.sum("_n").alias("listings"), F.count("*").alias("unique_cards")
    ).orderBy(F.desc("listings"), "rarity")


def title_number_counts(listings: DataFrame) -> DataFrame:
    """How often each card number occurs in the titles of a card."""
    return (
        listings.select(
            "card_name", "card_number", F.explode(text.title_numbers(F.col("title"))).alias("found_number")
        )
        .groupBy("card_name", "card_number", "found_number")
        .agg(F.count("*").alias("times"))
    )


def search_terms_per_card(listings: DataFrame) -> DataFrame:
    """Distinct search terms per card; one row per card and term."""
    return listings.filter(
        (F.coalesce("search_terms", F.lit("")) != "") & (F.coalesce("card_name", F.lit("")) != "")
    ).groupBy("card_name", "search_terms").agg(F.count("*").alias("listings"))


def variant_groups(cards: DataFrame) -> DataFrame:
    """Cards per first word of their name, groups with more than one card."""
    base = text.empty_to_null(F.split(F.trim("card_name"), r"\s+")[0])
    return (
        cards.withColumn("base_name", base).filter(F.col("base_name").isNotNull())
        .groupBy("base_name").agg(F.count("*").alias("variants"))
        .filter(F.col("variants") > 1)
    )


def run_rollup(runs: DataFrame) -> DataFrame:
    """Totals of a collection-run log: items, successes, clean points, share of success.

    ``current_prices`` is a map, ``chart_points`` and ``table_points`` arrays of
    (date, price).
    """
    def clean(points: str) -> Column:
        return F.size(F.filter(F.col(points), lambda e: e["date"].isNotNull() & e["price"].isNotNull()))

    prices = F.map_filter("current_prices", lambda _k, v: text.sane_price(v))
    item = runs.select(
        "item_name", "item_type", "success",
        F.greatest(F.size(prices), F.lit(0)).alias("current_prices_count"),
        F.greatest(clean("chart_points"), F.lit(0)).alias("historical_data_count"),
        F.greatest(clean("table_points"), F.lit(0)).alias("table_data_count"),
    )
    return item.withColumn(
        "total_clean_data_points", F.col("historical_data_count") + F.col("table_data_count")
    )


def run_totals(items: DataFrame) -> DataFrame:
    """Sums over :func:`run_rollup` rows."""
    good = F.count_if(F.col("success"))
    return items.agg(
        F.count("*").alias("total_targets"),
        good.alias("successful_collections"),
        (F.count("*") - good).alias("failed_collections"),
        half_up(F.coalesce(ratio(good, F.count("*")), F.lit(0.0)) * 100, 4).alias("success_rate"),
        F.sum("current_prices_count").alias("filtered_prices"),
        F.sum("historical_data_count").alias("clean_historical"),
        F.sum("table_data_count").alias("clean_table"),
    )


def richest_items(items: DataFrame, limit: int = 5) -> DataFrame:
    return items.orderBy(F.desc("total_clean_data_points"), "item_name").limit(limit)
