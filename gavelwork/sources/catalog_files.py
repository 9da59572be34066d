"""Cached catalog files: one JSON array per set, a list of sets, chart-history dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelwork.sources import pages

CARD_SCHEMA = "name string, number string, rarity string, set_name string, set_series string"
SET_SCHEMA = (
    "id string, name string, releaseDate string, total int, printedTotal int, series string"
)
API_CARD_SCHEMA = (
    "data array<struct<name: string, number: string, rarity: string,"
    " set: struct<name: string, series: string>>>"
)
API_SET_SCHEMA = (
    "data array<struct<id: string, name: string, releaseDate: string, total: int,"
    " printedTotal: int, series: string>>"
)
PRICES = "map<string, double>"
CHART = f"struct<current_prices: {PRICES}, url: string, historical_chart_data: array<struct<date: string, price: double>>>"
HISTORY_SCHEMA = (
    f"cards array<struct<card_id: string, pricecharting_data: {CHART}>>,"
    f" sealed_products array<struct<product_id: string, pricecharting_data: {CHART}>>"
)


def card_files(spark: SparkSession, folder: str) -> DataFrame:
    """All ``cards_<set>.json`` files, the set id taken from the file name."""
    rows = spark.read.schema(CARD_SCHEMA).json(f"{folder}/cards_*.json", multiLine=True)
    return rows.withColumn(
        "set_id", F.regexp_extract(F.col("_metadata.file_name"), r"cards_(.+)\.json", 1)
    )


def set_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SET_SCHEMA).json(path, multiLine=True)


def cards_from_payload(payload: DataFrame) -> DataFrame:
    """Card rows of catalog payloads (column ``payload``: JSON text)."""
    card = F.explode(F.from_json("payload", API_CARD_SCHEMA)["data"])
    return payload.select(card.alias("c")).select(
        "c.name", "c.number", "c.rarity",
        F.col("c.set.name").alias("set_name"), F.col("c.set.series").alias("set_series"),
    )


def sets_from_payload(payload: DataFrame) -> DataFrame:
    """Set rows of catalog payloads (column ``payload``: JSON text)."""
    return payload.select(F.explode(F.from_json("payload", API_SET_SCHEMA)["data"]).alias("s")).select("s.*")


def latest_history(spark: SparkSession, folder: str, prefix: str = "pricecharting_historical_") -> DataFrame:
    """Chart history of the newest dump; the newest file name sorts last.

    The newest name is found from file metadata alone, then only that file is parsed.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/{prefix}*.json").select("path")
    newest = files.agg(F.max("path")).first()[0]
    return spark.read.schema(HISTORY_SCHEMA).json(newest, multiLine=True)


def mixed_history(spark: SparkSession, path: str) -> DataFrame:
    """(product_id, price_date, price) of landed chart dumps, one JSON object per line, whatever shape their
    points have: ``{"date": .., "price": ..}`` or ``[date, .., price]``, the price last.

    Lines are VARIANTs, so a column of mixed shape needs no second schema. A line that is no JSON, or a
    field that is no date or number, gives NULL and not an error.
    """
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    records = lines.select(
        pages.variant_text(F.col("v"), "$.card_id", "$.product_id").alias("product_id"),
        F.explode_outer(pages.variant_list(F.try_variant_get("v", "$.historical_chart_data", "variant"))).alias("e"),
    )
    entries = pages.variant_list(F.col("e"))
    last = F.get(entries, F.size(entries) - 1)
    price = F.coalesce(F.try_variant_get("e", "$.price", "double"), F.try_variant_get(last, "$", "double"))
    return records.select("product_id", pages.variant_text(F.col("e"), "$.date", "$[0]").try_cast("date").alias("price_date"), price.alias("price"))


def chart_prices(history: DataFrame) -> DataFrame:
    """Current chart prices per card, one row each."""
    return history.select(F.explode("cards").alias("c")).select(
        F.col("c.card_id").alias("card_id"),
        F.col("c.pricecharting_data.current_prices")["current"].alias("pc_current_price"),
        F.col("c.pricecharting_data.current_prices")["loose"].alias("pc_loose_price"),
        F.col("c.pricecharting_data.current_prices")["graded"].alias("pc_graded_price"),
        F.col("c.pricecharting_data.current_prices")["new"].alias("pc_new_price"),
        F.col("c.pricecharting_data.url").alias("pc_url"),
    )


def history_points(history: DataFrame) -> DataFrame:
    """Historical chart points of cards and sealed products."""
    def part(name: str, key: str) -> DataFrame:
        return history.select(F.explode(name).alias("c")).select(
            F.col(f"c.{key}").alias("product_id"),
            F.explode("c.pricecharting_data.historical_chart_data").alias("h"),
        ).select("product_id", F.col("h.date").try_cast("date").alias("price_date"), F.col("h.price").alias("price"))

    return part("cards", "card_id").unionByName(part("sealed_products", "product_id"))
