"""Catalog selection, product search, target matching and set roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelwork.functions.text import any_contains
from gavelwork.rules import fixed


def custom_filter(cards: DataFrame, filters: Mapping) -> DataFrame:
    """A list means IN, a scalar means equality."""
    for column, value in filters.items():
        test = F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value)
        cards = cards.filter(test)
    return cards


def like(column: Column, part: str, escape: bool = False) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` act as wildcards unless escaped."""
    if escape:
        part = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{part}%")


def by_names(cards: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cards whose name contains any of the names, each card once."""
    test = F.lit(False)
    for name in names:
        test = test | like(F.col("card_name"), name)
    return distinct_cards(cards.filter(test))


def by_sets(cards: DataFrame, set_names: Sequence[str]) -> DataFrame:
    return cards.filter(F.col("set_name").isin(*set_names))


def sample(cards: DataFrame, n: int = 10) -> DataFrame:
    return cards.orderBy("card_id").limit(n)


def page(cards: DataFrame, size: int = 1000, offset: int = 0) -> DataFrame:
    """One page of the catalog in key order."""
    return cards.orderBy("card_id").offset(offset).limit(size)


def high_value(cards: DataFrame) -> DataFrame:
    """Cards with a sought-after name or rarity."""
    name = F.lower(F.coalesce("card_name", F.lit("")))
    rarity = F.lower(F.coalesce("rarity", F.lit("")))
    return cards.filter(any_contains(name, fixed.HIGH_VALUE_NAMES) | any_contains(rarity, fixed.HIGH_VALUE_RARITIES))


def distinct_cards(cards: DataFrame, keys: Sequence[str] = ("card_name", "set_name", "card_number")) -> DataFrame:
    """First card (smallest id) of every name, set and number."""
    first = Window.partitionBy(*keys).orderBy("card_id")
    return cards.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")


def tracking_summary(cards: DataFrame) -> DataFrame:
    """Cards and distinct sets, names and rarities of a selection."""
    per = cards.groupBy("set_name", "card_name", "rarity").agg(F.count("*").alias("_n"))
    return per.agg(
        F.sum("_n").alias("total"),
        F.countDistinct("set_name").alias("sets"),
        F.countDistinct("card_name").alias("names"),
        F.countDistinct("rarity").alias("rarities"),
    )


def sealed_or_fallback(sealed: DataFrame) -> DataFrame:
    """The sealed catalog; a fixed short list when it is empty."""
    if not sealed.isEmpty():
        return sealed
    return sealed.sparkSession.createDataFrame(
        list(fixed.FALLBACK_SEALED),
        "sealed_product_id bigint, product_name string, set_name string, product_type string, msrp double",
    )


# -- search -----------------------------------------------------------------------------------


def find_products(names: Sequence[str], cards: DataFrame, sealed: DataFrame, per_catalog: int = 5,
                  sealed_first: bool = False) -> DataFrame:
    """Matches of every search text in both catalogs, at most ``per_catalog`` each, ranked.

    The texts are a short literal list, so each catalog is scanned once and a row offers
    itself to the texts it contains; no join is involved.
    """
    order = {"sealed": 0, "card": 1} if sealed_first else {"card": 0, "sealed": 1}

    def part(rows: DataFrame, kind: str, key: str, name: str) -> DataFrame:
        hits = F.array_compact(F.array(*[F.when(like(F.col(name), n), F.lit(n)) for n in names]))
        ranked = Window.partitionBy("query").orderBy("product_key")
        return (
            rows.select(
                F.explode(hits).alias("query"),
                F.lit(kind).alias("product_type"),
                F.col(key).alias("product_key"),
                F.col(name).alias("product_name"),
                "set_name",
                F.lit(order[kind]).alias("catalog_rank"),
            )
            .withColumn("rank", F.row_number().over(ranked))
            .filter(F.col("rank") <= per_catalog)
        )

    return part(cards, "card", "card_id", "card_name").unionByName(
        part(sealed, "sealed", "sealed_product_id", "product_name")
    )


def first_match(matches: DataFrame) -> DataFrame:
    """The match to use per search text, with the number of matches."""
    best = F.min_by(
        F.struct("product_type", "product_key", "product_name", "set_name"),
        F.struct("catalog_rank", "rank"),
    )
    return matches.groupBy("query").agg(best.alias("_b"), F.count("*").alias("match_count")).select(
        "query", "_b.*", "match_count"
    )


def target_matches(cards: DataFrame, targets: Sequence[tuple[str, str, str]] = fixed.CURATED_TARGETS) -> DataFrame:
    """Catalog cards for a short list of targets (name, set, number).

    All exact matches of a target; without any, the first card whose name and set contain
    the target's. The list is literal, so a scan tests every card against it. Exact
    matches pass straight through; the fallback is one combined aggregate per target.
    """
    def exact(target: tuple[str, str, str]) -> Column:
        name, set_name, number = target
        return (F.col("card_name") == name) & (F.col("set_name") == set_name) & (F.col("card_number") == number)

    def near(target: tuple[str, str, str]) -> Column:
        return like(F.col("card_name"), target[0]) & like(F.col("set_name"), target[1])

    def hits(test) -> Column:
        return F.array_compact(F.array(*[F.when(test(t), F.lit(i)) for i, t in enumerate(targets)]))

    columns = cards.columns
    found = cards.withColumn("_target", F.explode(hits(exact))).withColumn("match_kind", F.lit("exact"))
    fallback = (
        cards.withColumn("_exact", hits(exact))
        .withColumn("_target", F.explode(hits(lambda t: exact(t) | near(t))))
        .groupBy("_target")
        .agg(
            F.bool_or(F.array_contains("_exact", F.col("_target"))).alias("_has_exact"),
            F.min_by(F.struct(*columns), "card_id").alias("_card"),
        )
        .filter(~F.col("_has_exact"))
        .select("_card.*", "_target", F.lit("partial").alias("match_kind"))
    )
    names = F.array(*[F.lit(t[0]) for t in targets])
    return (
        found.unionByName(fallback)
        .withColumn("target_name", F.element_at(names, F.col("_target") + 1))
        .drop("_target")
    )


def select_items(strategy: str, cards: DataFrame, sealed: DataFrame, limit: int | None = None, *,
                 set_name: str | None = None, name: str | None = None, filters: Mapping | None = None,
                 offset: int = 0) -> DataFrame:
    """Items to collect, by strategy; cards come before sealed products under a limit."""
    if strategy == "high_value":
        chosen = high_value(cards)
    elif strategy == "curated":
        return combined_targets(distinct_cards(target_matches(cards)), sealed_or_fallback(sealed), limit)
    elif strategy == "diverse_sample":
        picked = by_names(cards, ["Charizard", "Pikachu"]).unionByName(sample(cards, 4))
        chosen = distinct_cards(picked)
    elif strategy == "by_set":
        chosen = by_sets(cards, [set_name])
    elif strategy == "by_name":
        chosen = by_names(cards, [name])
    elif strategy == "custom":
        chosen = custom_filter(cards, filters or {"rarity": "Rare Holo"})
    elif strategy == "all_cards":
        return page(cards, limit or 1000, offset)
    elif strategy == "sealed_only":
        chosen = sealed_or_fallback(sealed)
        return chosen if limit is None else chosen.orderBy("sealed_product_id").limit(limit)
    else:
        raise ValueError(f"unknown selection strategy: {strategy}")
    return chosen if limit is None else chosen.orderBy("card_id").limit(limit)


def combined_targets(cards: DataFrame, sealed: DataFrame, limit: int | None = None) -> DataFrame:
    """Cards then sealed products as one list of targets."""
    both = cards.select(
        F.lit("card").alias("target_type"), F.col("card_id").alias("target_id"),
        F.col("card_name").alias("target_name"), "set_name", F.lit(0).alias("_order"),
    ).unionByName(sealed.select(
        F.lit("sealed").alias("target_type"), F.col("sealed_product_id").alias("target_id"),
        F.col("product_name").alias("target_name"), "set_name", F.lit(1).alias("_order"),
    ))
    if limit is not None:
        both = both.orderBy("_order", "target_id").limit(limit)
    return both.drop("_order")


# -- sets ---------------------------------------------------------------------------------------


def rarity_breakdown(cards: DataFrame) -> DataFrame:
    """Cards per set and rarity (rarities are few, so the pairs stay small)."""
    return cards.groupBy("set_name", F.coalesce("rarity", F.lit("Unknown")).alias("rarity")).agg(
        F.count("*").alias("cards")
    )


def is_secret(number: Column, printed: Column) -> Column:
    """A whole card number above the printed total of its set."""
    return F.coalesce(number.rlike(r"^\d+$") & (number.try_cast("int") > printed), F.lit(False))


def secret_rare_counts(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Secret rares per set. ``sets`` holds ``set_name`` and ``printed_total``."""
    return (
        sets.join(cards.select("set_name", "card_number"), "set_name", "left")
        .groupBy("set_name", "printed_total")
        .agg(F.count_if(is_secret(F.col("card_number"), F.col("printed_total"))).alias("secret_rare_count"))
    )


def set_rows(sets: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows of the sets table: totals, secret rares, structure and rarity map.

    ``sets`` holds id, name, releaseDate, total, printedTotal, series; ``cards`` holds
    set_id, number, rarity. A set without total has no secret rares.
    """
    by_rarity = (
        cards.withColumn("rarity", F.coalesce("rarity", F.lit("Unknown")))
        .join(sets.select(F.col("id").alias("set_id"), "printedTotal"), "set_id")
        .groupBy("set_id", "rarity")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(
                (F.col("printedTotal") > 0) & is_secret(F.col("number"), F.col("printedTotal"))
            ).alias("_secret"),
        )
        .groupBy("set_id")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("rarity", "_n")))).alias("rarity_breakdown"),
            F.sum("_secret").alias("secret_rare_count"),
        )
    )
    empty = F.create_map().cast("map<string,bigint>")
    return sets.join(by_rarity, sets["id"] == by_rarity["set_id"], "left").select(
        F.col("name").alias("set_name"),
        F.col("releaseDate").alias("release_date"),
        "series",
        F.coalesce("total", F.lit(0)).alias("total_cards"),
        F.coalesce("printedTotal", F.lit(0)).alias("base_cards"),
        F.coalesce("secret_rare_count", F.lit(0)).alias("secret_rare_count"),
        F.struct(
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("printedTotal", F.lit(0)).alias("printed"),
            F.col("id").alias("api_id"),
        ).alias("structure"),
        empty.alias("products"),
        empty.alias("known_pull_rates"),
        F.coalesce("rarity_breakdown", empty).alias("rarity_breakdown"),
    )


def card_rows(cards: DataFrame) -> DataFrame:
    """Rows of the cards table; a null rarity becomes Unknown."""
    return cards.select(
        F.col("name").alias("card_name"),
        F.col("number").alias("card_number"),
        "set_name",
        F.coalesce(F.when(F.col("rarity") != "", F.col("rarity")), F.lit("Unknown")).alias("rarity"),
    )


def seed_sealed_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.SEED_SEALED), "product_name string, set_name string, product_type string, msrp double"
    )


def seed_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.SEED_PRODUCTS), "product_type string, product_id string, product_name string, set_name string"
    )


def seed_investments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.SEED_INVESTMENTS),
        "target_type string, target_id string, target_name string, investment_category string, watch_priority int",
    )
