"""Offline preparation: listings joined to cards and chart prices, features, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.functions.numbers import ratio
from gavelwork.operators import ingest, market

CHART_COLUMNS = ("pc_current_price", "pc_loose_price", "pc_graded_price", "pc_new_price", "pc_url")


def listings_with_cards(listings: DataFrame, cards: DataFrame, card_ids: DataFrame | None = None) -> DataFrame:
    """Listings with the attributes of their card; only cards of ``card_ids`` when given."""
    rows = listings.withColumnRenamed("product_id", "card_id")
    if card_ids is not None:
        rows = rows.join(card_ids.select("card_id"), "card_id", "left_semi")
    return rows.join(cards, "card_id")


def newest_listings(listings: DataFrame, cards: DataFrame, limit: int = 10000) -> DataFrame:
    """The newest listings that have a card, newest first."""
    joined = listings_with_cards(listings, cards)
    return joined.orderBy(F.desc("created_at"), "listing_id").limit(limit)


def unified(listings: DataFrame, chart: DataFrame | None) -> DataFrame:
    """Listings with the current chart prices of their card; NULL columns without chart."""
    if chart is None:
        for column in CHART_COLUMNS:
            listings = listings.withColumn(column, F.lit(None).cast("string" if column == "pc_url" else "double"))
        return listings
    return listings.join(chart.select("card_id", *CHART_COLUMNS), "card_id", "left")


def features(rows: DataFrame, as_of: Column) -> DataFrame:
    """Date parts, log price, grade, rarity rank, price against chart prices."""
    price = F.col("price").cast("double")

    def against(column: str) -> Column:
        return ratio(price, F.coalesce(F.col(column), price))

    return rows.withColumns({
        "year": F.year("sold_date").cast("bigint"),
        "month": F.month("sold_date").cast("bigint"),
        "quarter": F.quarter("sold_date").cast("bigint"),
        "day_of_week": F.weekday("sold_date").cast("bigint"),
        "days_since_sold": F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("sold_date")) / 86400),
        "log_price": F.log1p(price),
        "is_graded": F.coalesce("is_graded", F.lit(False)),
        "grade_numeric": F.col("grade").try_cast("double"),
        "rarity_rank": F.coalesce(text.rarity_rank(F.col("rarity")), F.lit(0)).cast("bigint"),
        "price_vs_pc_current": against("pc_current_price"),
        "price_premium_pc": (ratio(price, F.col("pc_current_price")) - 1) * 100,
        "price_vs_pc_loose": against("pc_loose_price"),
        "price_vs_pc_graded": against("pc_graded_price"),
    })


def prepare(listings: DataFrame, cards: DataFrame, chart: DataFrame | None, as_of: Column,
            card_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The unified dataset and the per-card statistics."""
    rows = features(unified(listings_with_cards(listings, cards, card_ids), chart), as_of)
    return rows, market.card_aggregates(rows)


def save(rows: DataFrame, statistics: DataFrame, folder: str, stamp: str) -> None:
    """Both results as CSV folders whose names carry the stamp."""
    ingest.write_csv(rows, f"{folder}/unified_dataset_{stamp}")
    ingest.write_csv(statistics, f"{folder}/card_stats_{stamp}")
