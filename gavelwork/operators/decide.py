"""Recommendations, grades, freshness verdicts and the analysis cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions.numbers import above, flag, half_up, steps, total
from gavelwork.rules import fixed


def _reasons(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, reason) for test, reason in pairs]))


def recommendation(analysis: DataFrame) -> DataFrame:
    """Verdict of the simple analysis: score, confidence, risk, target prices, reasons.

    Input: one row per product from ``metrics.basic_analysis``.
    """
    quality, vol = F.col("quality_score"), F.col("volatility_percent")
    trend, strength = F.col("trend_direction"), F.col("trend_strength")
    place, sources = F.col("current_vs_max"), F.col("source_count")
    rising = (trend == "rising") & (strength > 5)
    falling = (trend == "falling") & (strength > 10)
    score = total([
        F.when(quality >= 0.8, 1).when(quality < 0.4, -1).otherwise(0),
        F.when(vol < 15, 2).when(vol > 30, -1).otherwise(0),
        F.when(rising, 2).when(falling, -2).otherwise(0),
        F.when(place < 80, 1).when(place > 95, -1).otherwise(0),
        F.when(sources >= 2, 1).otherwise(0),
    ])
    base = quality * 0.7 + 0.3
    s = F.col("score")
    scored = analysis.withColumn("score", score)
    reasons = _reasons(
        (quality >= 0.8, F.format_string("High-quality data (score: %.2f) increases confidence", quality)),
        (quality < 0.4, F.format_string("Limited data quality (score: %.2f) reduces confidence", quality)),
        (vol < 15, F.format_string("Low volatility (%.1f%%) indicates stable pricing", vol)),
        (vol > 30, F.format_string("High volatility (%.1f%%) indicates risky investment", vol)),
        (rising, F.format_string("Strong upward trend (+%.1f%%)", strength)),
        (falling, F.format_string("Downward trend (-%.1f%%)", strength)),
        (place < 80, F.format_string("Currently %.0f%% below peak price", 100 - place)),
        (place > 95, F.lit("Currently near peak price")),
        (sources >= 2, F.format_string("Data validated across %d sources", sources)),
        (sources == 1, F.lit("Single data source - limited validation")),
    )
    share = vol / 100
    return scored.select(
        "product_id",
        s,
        F.when(s >= 4, "BUY").when(s <= -2, "AVOID").otherwise("HOLD").alias("recommendation"),
        half_up(
            F.when(s >= 4, F.least(F.lit(0.9), base + 0.2))
            .when((s >= 2) | (s <= -2), F.least(F.lit(0.8), base + 0.1))
            .when(s >= 0, base)
            .otherwise(base - 0.1), 2
        ).alias("confidence"),
        F.when(vol > 25, "HIGH").when(vol > 15, "MEDIUM").otherwise("LOW").alias("risk_level"),
        half_up(F.col("average") * (1 - (0.1 + share * 0.1)), 2).alias("buy_below"),
        half_up(F.col("average") * (1 + (0.15 + share * 0.15)), 2).alias("sell_above"),
        reasons.alias("reasoning"),
    )


def investment_grade(bundle: DataFrame) -> DataFrame:
    """0-100 score, letter and verdict from growth, risk, win rate and signals.

    A missing technical block still earns one signal: an absent RSI is not overbought.
    """
    cagr = F.coalesce(F.col("returns_analysis.cagr"), F.lit(0.0))
    sharpe = F.coalesce(F.col("risk_metrics.sharpe_ratio"), F.lit(0.0))
    wins = F.coalesce(F.col("performance_metrics.win_rate_pct"), F.lit(0.0))
    signals = total([
        flag(F.col("technical_indicators.sma_20_signal") == "bullish"),
        flag(F.col("technical_indicators.ema_20_signal") == "bullish"),
        F.when(F.col("technical_indicators.rsi_signal") == "overbought", 0).otherwise(1),
        flag(F.col("market_timing.entry_signal") == "buy"),
    ])
    score = (
        above(cagr, fixed.CAGR_POINTS, 0)
        + above(sharpe, fixed.SHARPE_POINTS, 0)
        + above(wins, fixed.WIN_RATE_POINTS, 0)
        + F.when(signals >= 3, 25).when(signals >= 2, 15).when(signals >= 1, 5).otherwise(0)
    )
    reasoning = F.array(
        F.concat(above(cagr, fixed.CAGR_POINTS, "Negative", 2), F.format_string(" CAGR of %.1f%%", cagr)),
        F.concat(above(sharpe, fixed.SHARPE_POINTS, "Poor", 2), F.format_string(" Sharpe ratio of %.2f", sharpe)),
        F.concat(above(wins, fixed.WIN_RATE_POINTS, "Low", 2), F.format_string(" win rate of %.1f%%", wins)),
        F.when(signals >= 3, "Strong technical indicators")
        .when(signals >= 2, "Mixed technical indicators")
        .when(signals >= 1, "Weak technical indicators")
        .otherwise("Bearish technical indicators"),
    )
    s = F.col("score")
    return (
        bundle.withColumn("score", score)
        .withColumn("grade", steps(s, fixed.GRADE_LETTERS, "F"))
        .withColumn(
            "investment_recommendation",
            F.when(s >= 70, "BUY").when(s >= 50, "HOLD").otherwise("AVOID"),
        )
        .withColumn("reasoning", reasoning)
    )


def rule_assessment(bundle: DataFrame) -> DataFrame:
    """Plain three-way verdict and risk level from growth, Sharpe ratio and drawdown."""
    cagr = F.coalesce(F.col("returns_analysis.cagr"), F.lit(0.0))
    sharpe = F.coalesce(F.col("risk_metrics.sharpe_ratio"), F.lit(0.0))
    deepest = F.coalesce(F.col("risk_metrics.max_drawdown_pct"), F.lit(0.0))
    strong = (cagr > 15) & (sharpe > 1.0) & (deepest > -20)
    fair = (cagr > 8) & (sharpe > 0.5)
    return (
        bundle.withColumn(
            "rule_recommendation", F.when(strong, "BUY").when(fair, "HOLD").otherwise("SELL")
        )
        .withColumn(
            "overall_assessment",
            F.when(strong, "Strong performance with acceptable risk")
            .when(fair, "Moderate performance with balanced risk")
            .otherwise("Poor risk-adjusted returns"),
        )
        .withColumn(
            "key_highlights",
            F.array(
                F.format_string("CAGR: %.1f%%", cagr),
                F.format_string("Sharpe Ratio: %.2f", sharpe),
                F.format_string("Max Drawdown: %.1f%%", deepest),
            ),
        )
        .withColumn(
            "rule_risk_level",
            F.when(deepest < -25, "HIGH").when(deepest < -15, "MEDIUM").otherwise("LOW"),
        )
    )


def combined_verdict(first: Column, second: Column) -> Column:
    """Mean of two verdicts on the five-step scale; unknown verdicts count as HOLD."""
    def score(verdict: Column) -> Column:
        chain = None
        for name, value in fixed.VERDICT_SCORES.items():
            test = verdict == name
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain.otherwise(3)

    mean = (score(first) + score(second)) / 2
    return (
        F.when(mean >= 4.5, "STRONG_BUY").when(mean >= 3.5, "BUY").when(mean >= 2.5, "HOLD")
        .when(mean >= 1.5, "SELL").otherwise("STRONG_SELL")
    )


def graded_recommendation(graded: DataFrame, second: str | None = None) -> DataFrame:
    """Verdict from the grade, averaged with a second verdict column where it is set."""
    own = F.col("score") / 100
    if second is None:
        final, confidence = F.col("investment_recommendation"), own
    else:
        has = F.col(second).isNotNull()
        final = F.when(has, combined_verdict(F.col("investment_recommendation"), F.col(second))).otherwise(
            F.col("investment_recommendation")
        )
        confidence = F.when(has, (own + 0.8) / 2).otherwise(own)
    return graded.withColumn("recommendation", final).withColumn("confidence", half_up(confidence, 2))


def analysis_record(recommended: DataFrame, as_of: Column, version: str = "2.0") -> DataFrame:
    """Rows of the analyses table: nested metrics, verdict, summary of the key numbers."""
    blocks = [
        "returns_analysis", "risk_metrics", "performance_metrics", "technical_indicators",
        "value_at_risk", "statistical_properties", "time_series_analysis", "market_timing",
    ]
    summary = F.struct(
        F.coalesce(F.col("returns_analysis.cagr"), F.lit(0.0)).alias("cagr"),
        F.coalesce(F.col("risk_metrics.sharpe_ratio"), F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce(F.col("risk_metrics.max_drawdown_pct"), F.lit(0.0)).alias("max_drawdown"),
        F.col("grade").alias("investment_grade"),
    )
    return recommended.select(
        "product_id",
        as_of.alias("analysis_date"),
        F.to_json(F.struct(*blocks)).alias("metrics"),
        summary.alias("performance_summary"),
        "recommendation",
        F.col("confidence").alias("confidence_score"),
        F.lit(version).alias("analysis_version"),
        F.col("start_date").alias("data_range_start"),
        F.col("end_date").alias("data_range_end"),
        F.col("total_points").alias("total_data_points"),
    )


# -- freshness and cache ------------------------------------------------------------------


def freshness(products: DataFrame, listings: DataFrame, as_of: Column, max_age_days: int = 7) -> DataFrame:
    """Age of every product's listings and what to refresh.

    The listings are counted per product before the join, so neither side of the join
    grows with the number of listings. Products without listings have NULL age.
    """
    seen = listings.groupBy("product_type", "product_id").agg(
        F.count("*").alias("listing_count"), F.max("created_at").alias("last_update")
    )
    joined = products.join(seen, ["product_type", "product_id"], "left")
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_update")) / 86400).cast("bigint")
    aged = joined.withColumn("listing_count", F.coalesce("listing_count", F.lit(0))).withColumn("days_old", age)
    fresh = F.coalesce(F.col("days_old") <= max_age_days, F.lit(False))
    near = F.coalesce(F.col("days_old") <= 2 * max_age_days, F.lit(False)) & (F.col("listing_count") > 0)
    return aged.withColumn("is_fresh", fresh).withColumn(
        "recommended_action",
        F.when(fresh, "use_cache").when(near, "scrape_pricecharting_only").otherwise("scrape_both"),
    )


def freshness_of_names(found: DataFrame, checked: DataFrame) -> DataFrame:
    """Freshness per searched name; names without a product ask for a full setup."""
    return found.join(
        checked.drop("product_name", "set_name"), ["product_type", "product_id"], "left"
    ).withColumn(
        "recommended_action",
        F.when(F.col("product_id").isNull(), "full_setup").otherwise(F.col("recommended_action")),
    )


def stale_products(products: DataFrame, as_of: Column, max_age_days: int = 7, limit: int | None = 20) -> DataFrame:
    """Products last updated before the cutoff, oldest first. A NULL update never counts."""
    cutoff = as_of - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
    rows = products.filter(F.col("last_data_update") < cutoff).orderBy(
        "last_data_update", "product_type", "product_id"
    )
    return rows if limit is None else rows.limit(limit)


def cached_analyses(analyses: DataFrame, as_of: Column, max_age_hours: int = 24, min_version: str | None = None) -> DataFrame:
    """Newest analysis per product that is young enough (and of a high enough version)."""
    cutoff = as_of - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    rows = analyses.filter(F.col("analysis_date") >= cutoff)
    if min_version is not None:
        rows = rows.filter(F.col("analysis_version") >= min_version)
    return latest_per_key(rows, ["product_id"], "analysis_date", *_tie(analyses))


def _tie(analyses: DataFrame) -> list[str]:
    """Of analyses of one date the one with the largest id is the newer."""
    return [c for c in ("analysis_id",) if c in analyses.columns]


def split_by_cache(products: DataFrame, cached: DataFrame) -> DataFrame:
    """Every product with ``used_cache``; those without it have to be computed again."""
    hit = cached.select("product_id", F.lit(True).alias("_hit"), "recommendation", "confidence_score")
    return products.join(hit, "product_id", "left").withColumn(
        "used_cache", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def latest_per_key(rows: DataFrame, keys: list[str], newest: str, *ties: str) -> DataFrame:
    """The newest row of every key. The rank filter reaches below the shuffle."""
    by_age = Window.partitionBy(*keys).orderBy(F.desc(newest), *[F.desc(t) for t in ties])
    return rows.withColumn("_rank", F.row_number().over(by_age)).filter(F.col("_rank") == 1).drop("_rank")


def analysis_history(analyses: DataFrame, product_ids=None, limit: int = 10) -> DataFrame:
    """Newest analyses of the given products (of all without), at most ``limit`` each."""
    newest = [F.desc(c) for c in ("analysis_date", *_tie(analyses))]
    by_age = Window.partitionBy("product_id").orderBy(*newest)
    rows = analyses if product_ids is None else analyses.filter(F.col("product_id").isin(*product_ids))
    return (
        rows.withColumn("_rank", F.row_number().over(by_age))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
        .orderBy("product_id", *newest)
    )


def audit_advice(audit: DataFrame) -> DataFrame:
    """Advice strings from an audit row: kind, suspicious count, outliers, lowest price."""
    box = (F.col("product_type") == "sealed") & F.lower("product_name").contains("booster box")
    return audit.withColumn(
        "advice",
        _reasons(
            (box, F.lit("Add minimum price filter: Booster boxes should be at least $50")),
            (box, F.lit("Filter titles containing: 'empty', 'box only', 'just box', 'no cards'")),
            (box, F.lit("Filter damaged indicators: 'damaged', 'torn', 'opened', 'resealed'")),
            (F.col("suspicious_count") > 10,
             F.lit("High number of suspicious listings detected - implement stricter filtering")),
            (F.col("outlier_count") > 5, F.lit("Consider more aggressive IQR-based outlier removal")),
            (F.col("min_price") < 10, F.lit("Implement minimum price threshold based on product type")),
        ),
    )
