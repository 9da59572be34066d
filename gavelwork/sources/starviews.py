"""Listing, catalog and price-point views over star-schema sales tables.

The tables hold orders, line items, parts and events. One line item plays one sold
listing, one part one catalog entry (a card and a sealed product of the same id), one
event one chart price point. All columns are expressions over the tables, so filters
and column pruning reach the parquet scan, and no join is made unless a view needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words the titles are put together from; the position is picked by the row's keys.
NAMES = ("Charizard", "Pikachu", "Mewtwo", "Lugia", "Rayquaza", "Umbreon", "Dragonite", "Gengar")
SUFFIXES = ("V", "VMAX", "ex", "GX", "VSTAR")
SETS = (
    "Base Set", "Evolving Skies", "Brilliant Stars", "Darkness Ablaze", "Celebrations",
    "Fusion Strike", "Silver Tempest", "Lost Origin",
)
KINDS = (
    "Booster Box", "Elite Trainer Box", "Theme Deck", "Tin", "Collection Box", "Booster Bundle",
)
PHRASES = (
    "PSA 10 Gem Mint", "BGS 9.5", "CGC 9 holo", "near mint pokemon card", "booster box sealed",
    "elite trainer box new", "4 pack blister", "empty box only", "damaged corner", "lot of 10",
    "36 packs factory sealed", "psa 9 full art", "proxy custom", "single pack", "tcg promo",
    "theme deck opened", "booster pack", "12 packs", "secret rare nm", "ETB",
)
CONDITIONS = ("PSA 10", "PSA 9", "PSA 8", "BGS 9.5", "CGC 9", "New (Other)", "Pre-owned")
TERMS = (
    "psa 10", "psa 9", "near mint", "nm", "elite trainer box", "collection box", "booster box",
)
GRADES = ("10", "9", "9.5", "8")
GRADERS = ("PSA", "BGS", "CGC", "PSA")
RARITIES = {
    "SMALL": "Common", "STANDARD": "Uncommon", "ECONOMY": "Rare", "MEDIUM": "Rare Holo",
    "PROMO": "Ultra Rare", "LARGE": "Secret Rare",
}
AS_OF = "2001-11-05"
EVENTS_AS_OF = "2024-01-31"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as it lies in the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(words: tuple[str, ...], position: Column) -> Column:
    """``words[position % len(words)]``."""
    index = (position % F.lit(len(words)) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(w) for w in words]), index)


def card_name(key: Column) -> Column:
    return F.concat_ws(" ", pick(NAMES, key), pick(SUFFIXES, key))


def set_name(key: Column) -> Column:
    return pick(SETS, F.floor(key / 8))


def card_number(key: Column) -> Column:
    return F.concat((key % 200 + 1).cast("string"), F.lit("/200"))


def sealed_name(key: Column) -> Column:
    return F.concat_ws(" ", set_name(key), pick(KINDS, key))


def listings_of(item: DataFrame) -> DataFrame:
    """Listings of line items (a table or a stream); ``order_key`` leads to the order."""
    key, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    shown = key + F.when(supp % 10 == 0, 1).otherwise(0)
    sealed = F.col("l_returnflag") == "A"
    graded = F.col("l_returnflag") == "R"
    cents = F.expr(
        "(2 * CAST(round(l_extendedprice * 100) AS BIGINT) + 10 * CAST(l_quantity AS BIGINT))"
        " DIV (20 * CAST(l_quantity AS BIGINT))"
    )
    number = F.concat(
        (key % 200 + 1 + F.when(line == 7, 1).otherwise(0)).cast("string"), F.lit("/200")
    )
    columns = [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("listing_url"),
        F.when(sealed, "sealed").otherwise("card").alias("product_type"),
        key.alias("product_id"),
        F.when(sealed, sealed_name(key)).otherwise(card_name(key)).alias("product_name"),
        F.concat_ws(
            " ", card_name(shown), set_name(shown), pick(PHRASES, supp + line), number
        ).alias("title"),
        (cents / 100).alias("price"),
        F.col("l_shipdate").alias("sold_date"),
        F.when(F.col("l_linestatus") == "O", "ebay").otherwise("pricecharting").alias("source"),
        graded.alias("is_graded"),
        F.when(graded, "graded").when(sealed, "sealed").otherwise("raw").alias("condition_category"),
        pick(CONDITIONS, line - 1).alias("condition"),
        F.concat_ws(" ", card_name(key), pick(TERMS, line - 1)).alias("search_terms"),
        F.when(graded, pick(GRADES, supp)).alias("grade"),
        F.when(graded, pick(GRADERS, supp)).alias("grading_company"),
        F.col("l_orderkey").alias("order_key"),
    ]
    return item.select(*columns)


def listings(spark: SparkSession, sf_dir: str, with_created: bool = False) -> DataFrame:
    """Sold listings, one per line item.

    ``with_created`` joins the orders for ``created_at``; leave it off where the column
    is not needed, the join is the one shuffle of this view.
    """
    view = listings_of(read(spark, sf_dir, "lineitem"))
    if with_created:
        orders = read(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("created_at")
        )
        view = view.join(orders, "order_key")
    return view.drop("order_key")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card catalog, one per part."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("card_id"),
        card_name(key).alias("card_name"),
        set_name(key).alias("set_name"),
        card_number(key).alias("card_number"),
        F.element_at(
            F.create_map(*[F.lit(x) for pair in RARITIES.items() for x in pair]), F.col("p_type")
        ).alias("rarity"),
        F.col("p_name").alias("variant"),
        F.col("p_brand").alias("series"),
    )


def sealed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed-product catalog, one per part."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("sealed_product_id"),
        sealed_name(key).alias("product_name"),
        set_name(key).alias("set_name"),
        pick(KINDS, key).alias("product_type"),
        F.col("p_retailprice").alias("msrp"),
    )


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart price points, one per event."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"),
        F.col("event_id").alias("point_id"),
        F.col("ts"),
        F.to_date("ts").alias("price_date"),
        F.col("value").alias("price"),
        F.col("event_type").alias("source"),
    )


def chart_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current chart prices per card; parts of the smallest sizes have no chart."""
    return read(spark, sf_dir, "part").filter(F.col("p_size") > 10).select(
        F.col("p_partkey").alias("card_id"),
        (F.col("p_retailprice") / 10).alias("pc_current_price"),
        (F.col("p_retailprice") / 12).alias("pc_loose_price"),
        (F.col("p_retailprice") / 5).alias("pc_graded_price"),
        (F.col("p_retailprice") / 4).alias("pc_new_price"),
        F.concat(F.lit("https://chart.example/"), F.col("p_partkey").cast("string")).alias("pc_url"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document verdicts as JSON text, some fields left out where a label is missing."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read(spark, sf_dir, "labels")
    kind = pick(("booster_box", "tin", "single_card", "bundle"), F.col("doc_id"))
    action = (
        F.when(F.col("toxic") == 1, "remove").when(F.col("quality") == 1, "keep").otherwise("flag")
    )
    body = F.when(
        F.col("quality").isNotNull(),
        F.to_json(F.struct(
            action.alias("action"),
            F.when(F.col("quality") == 1, 0.9).alias("confidence"),
            F.col("lang").alias("language"),
            kind.alias("product_type"),
            F.col("source").alias("reasoning"),
        )),
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("listing_id"),
        (F.col("n_chars") % 300 + 1).cast("double").alias("price"),
        body.alias("verdict"),
    )
