"""Typed listing rows, URL dedup, keyed merges and appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.operators import versioned


def prepare_listings(rows: DataFrame, sealed: Column, as_of: Column) -> DataFrame:
    """Typed rows from parsed listings: strategy, condition slot, whole grade, sale date.

    Rows without title or URL are dropped. ``sold_text`` is the sale-date text. Sealed
    products are never graded.
    """
    graded = F.coalesce(F.col("is_graded"), F.lit(False)) & ~sealed
    blank = F.lit("")
    return (
        rows.filter((F.coalesce("title", blank) != "") & (F.coalesce("listing_url", blank) != ""))
        .withColumns({
            "title": F.trim("title"),
            "listing_url": F.trim("listing_url"),
            "price": F.coalesce(F.col("price").cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")),
            "search_strategy": text.search_strategy(F.col("search_terms"), sealed),
            "condition_category": F.when(sealed, "sealed").when(graded, "graded").otherwise("raw"),
            "grade_numeric": F.when(~sealed, text.whole_grade(F.col("grade"))),
            "grade": F.when(sealed, blank).otherwise(F.coalesce("grade", blank)),
            "grading_company": F.when(sealed, blank).otherwise(F.coalesce("grading_company", blank)),
            "sold_date": text.parse_sale_date(F.col("sold_text"), F.year(as_of)),
            "created_at": as_of,
        })
        .withColumn("is_graded", graded)
        .drop("sold_text")
    )


def first_per_url(listings: DataFrame, arrival: Sequence[str] = ("listing_id",), key: str = "listing_url") -> DataFrame:
    """First row of every URL in arrival order; empty URLs are dropped.

    The rank limit runs before the shuffle too, so a URL that fills a third of the input
    sends one row per task.
    """
    order = Window.partitionBy(key).orderBy(*arrival)
    return (
        listings.filter(F.coalesce(F.col(key), F.lit("")) != "")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def new_listings(batch: DataFrame, stored: DataFrame, arrival: Sequence[str] = ("listing_id",),
                 key: str = "listing_url") -> DataFrame:
    """Rows of the batch whose URL is not stored yet, each URL once."""
    return first_per_url(batch, arrival, key).join(stored.select(key), key, "left_anti")


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored (insert, on conflict do nothing).

    Of several incoming rows of a key the first by its other columns, as text, is inserted.
    """
    others = [F.col(f"`{c}`").cast("string").asc_nulls_last() for c in incoming.columns if c not in keys]
    first = Window.partitionBy(*keys).orderBy(*(others or [F.lit(1)]))
    once = incoming.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
    return once.join(stored.select(*keys), list(keys), "left_anti")


def surrogate_key(*columns: str) -> Column:
    """The same id for the same key on every run."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def ensure_products(products: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """The product table with a row for every candidate (type, id, name, set)."""
    fresh = insert_missing(products, candidates, ["product_type", "product_id"]).select(
        text.product_key().alias("id"),
        "product_type", "product_id", "product_name", "set_name",
        as_of.alias("last_data_update"),
        F.lit(0.5).cast("decimal(3,2)").alias("data_quality_score"),
    )
    return products.unionByName(fresh, allowMissingColumns=True)


def catalog_defaults(names: DataFrame) -> DataFrame:
    """Catalog rows with defaults taken from the product name, for names not in a catalog."""
    name = F.col("product_name")
    trainer = name.contains("Elite Trainer Box")
    sealed = F.col("product_type") == "sealed"
    return names.select(
        "product_type", name,
        F.when(name.contains("151"), "151").otherwise("Unknown").alias("set_name"),
        F.when(~sealed, "1").alias("card_number"),
        F.when(~sealed, "Rare").alias("rarity"),
        F.when(sealed & trainer, "Elite Trainer Box").when(sealed, "Booster Box").alias("sealed_type"),
        F.when(sealed & trainer, 49.99).when(sealed, 143.64).alias("msrp"),
    )


def touch_products(products: DataFrame, touched: DataFrame, as_of: Column) -> DataFrame:
    """``last_data_update`` set on the touched products."""
    hit = touched.select("product_type", "product_id").distinct().withColumn("_hit", F.lit(True))
    return products.join(hit, ["product_type", "product_id"], "left").withColumn(
        "last_data_update", F.when(F.col("_hit"), as_of).otherwise(F.col("last_data_update"))
    ).drop("_hit")


def reset_products(products: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products that have a series lose it: their state is reset, their rows removed."""
    have = series.select("product_id").distinct()
    hit = have.withColumn("_hit", F.lit(True))
    cleared = products.join(hit, "product_id", "left").withColumns({
        "last_data_update": F.when(F.col("_hit").isNull(), F.col("last_data_update")),
        "data_quality_score": F.when(F.col("_hit").isNull(), F.col("data_quality_score")).otherwise(
            F.lit(0).cast("decimal(3,2)")
        ),
    }).drop("_hit")
    return cleared, series.join(products.select("product_id"), "product_id", "left_anti")


# -- sinks ---------------------------------------------------------------------------------------


def read_merged(spark: SparkSession, path: str, touched: DataFrame | None = None, parts: bool = False) -> DataFrame:
    """A stored table as it stands, or the rows of the keys in ``touched`` alone, see ``versioned.read``."""
    return versioned.read(spark, versioned.table(spark, path), touched, parts=parts)


def upsert(path: str, incoming: DataFrame, keys: Sequence[str], newest: Column | None = None,
           bucket_by: Sequence[str] | None = None, buckets: int | None = None, run: str | None = None, batch: int | None = None) -> bool:
    """Keyed merge into a stored table (created when missing): the incoming row of a key counts.

    Only the incoming rows are written; the newest row of a key is found on reading. A repeated
    (run, batch) is left out, see ``versioned``.
    """
    return versioned.write(versioned.table(incoming.sparkSession, path, keys, bucket_by, buckets), incoming, newest, run, batch)


SERIES_KEY = ("product_id", "price_date", "source", "condition_category")


def store_series(path: str, series: DataFrame, run: str | None = None, batch: int | None = None) -> bool:
    """Series upsert on product, day, source and condition."""
    return upsert(path, series, SERIES_KEY, run=run, batch=batch)


def store_analyses(path: str, records: DataFrame, run: str | None = None, batch: int | None = None) -> bool:
    """Append analysis records; those of a (run, batch) that is stored are left out."""
    return versioned.write(versioned.table(records.sparkSession, path), records, run=run, batch=batch)


def store_sets(path: str, sets: DataFrame) -> bool:
    return upsert(path, sets, ["set_name"])


def store_cards(path: str, cards: DataFrame) -> bool:
    return upsert(path, cards, ["set_name", "card_number"], F.col("card_name"))


def store_market_summaries(path: str, summaries: DataFrame, run: str | None = None, batch: int | None = None) -> bool:
    return upsert(path, summaries, ["product_id"], run=run, batch=batch)


#: What stored listing counts are counted by; series and market summaries are read off them.
COUNT_KEY = ("product_id", "price_date", "source", "condition_category", "search_strategy", "sold_date", "price")


def store_counts(path: str, counts: DataFrame, run: str | None = None, batch: int | None = None) -> bool:
    """Add counts (``COUNT_KEY``, n_rows) to the stored ones."""
    at = versioned.table(counts.sparkSession, path, COUNT_KEY, ["product_id"], sums=["n_rows"])
    return versioned.write(at, counts.select(*COUNT_KEY, "n_rows"), run=run, batch=batch)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
