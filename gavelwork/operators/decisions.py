"""Routing of listings by a table of per-listing verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up, ratio
from gavelwork.functions.text import price_reasonableness

VERDICT_SCHEMA = (
    "action string, confidence double, reasoning string, language string, product_type string,"
    " condition string, is_authentic boolean"
)


def expected_kind(product_name: Column) -> Column:
    """Kind a product's listings should have, from the product's name."""
    low = F.lower(product_name)
    return (
        F.when(low.contains("booster box"), "booster_box")
        .when(low.contains("elite trainer"), "elite_trainer_box")
        .when(low.contains("collection box"), "collection_box")
        .otherwise("unknown")
    )


def parse_verdicts(rows: DataFrame, expected: Column | None = None) -> DataFrame:
    """Verdict JSON to columns; missing fields get their defaults, missing verdicts are flagged."""
    v = F.from_json("verdict", VERDICT_SCHEMA)
    expected = F.lit("unknown") if expected is None else expected
    parsed = rows.withColumn("_v", v)
    field = lambda name: F.col(f"_v.{name}")
    return parsed.select(
        "listing_id", "price",
        F.coalesce(field("action"), F.lit("flag")).alias("action"),
        F.coalesce(field("confidence"), F.lit(0.5)).alias("confidence"),
        F.coalesce(field("reasoning"), F.lit("No reason provided")).alias("reason"),
        F.coalesce(field("language"), F.lit("unknown")).alias("detected_language"),
        F.coalesce(field("product_type"), F.lit("unknown")).alias("detected_product_type"),
        F.coalesce(field("condition"), F.lit("unknown")).alias("detected_condition"),
        F.coalesce(field("is_authentic"), F.lit(True)).alias("is_authentic"),
        price_reasonableness(F.col("price"), F.coalesce(field("product_type"), expected)).alias("price_reasonableness"),
    ).withColumn(
        "route",
        F.when(F.col("action") == "keep", "kept").when(F.col("action") == "remove", "removed").otherwise("flagged"),
    )


def kept(decisions: DataFrame) -> DataFrame:
    """Only what the verdicts keep passes on; flagged listings do not."""
    return decisions.filter(F.col("route") == "kept")


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Counts and rates per route, mean confidence. No rows give no summary."""
    n = F.count("*")

    def rows(route: str) -> Column:
        return F.count_if(F.col("route") == route)

    def rate(route: str) -> Column:
        return half_up(ratio(rows(route), n), 4)

    return decisions.agg(
        n.alias("total_analyzed"),
        rows("kept").alias("kept_count"),
        rows("removed").alias("removed_count"),
        rows("flagged").alias("flagged_count"),
        rate("kept").alias("keep_rate"),
        rate("removed").alias("removal_rate"),
        rate("flagged").alias("flag_rate"),
        half_up(F.avg("confidence"), 4).alias("avg_confidence"),
    ).filter(F.col("total_analyzed") > 0)


def decisions_by(decisions: DataFrame, column: str) -> DataFrame:
    """Decisions per detected language or product type."""
    return decisions.groupBy(column).agg(F.count("*").alias("listings"))
