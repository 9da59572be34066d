"""Return, risk, technical, tail, distribution, seasonality and timing metrics per product.

Input is a price series (one row per product, day, source and condition), so a product
has at most *days x slots* rows, whatever the number of listings behind them; that bound
is what makes one window partition per product safe. All windows share one partitioning
and one order, and the grouped metrics reuse it: one exchange from the series to the
metric row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up, ratio, steps
from gavelwork.rules import fixed

ORDER = ("price_date", "source", "condition_category")
BLOCK_GATES = {
    "returns": 2, "risk": 2, "performance": 2, "var": 10, "distribution": 10,
    "technical": 20, "timing": 20, "seasonality": 30,
}
ANNUAL = fixed.DAYS_PER_YEAR**0.5


def with_returns(series: DataFrame, key: str = "product_id", order: Sequence[str] = ORDER) -> DataFrame:
    """Position, previous price, simple and log return of every point.

    The first return is 0 and counts. A point after a zero price has no finite return
    and is dropped. ``ord`` counts from the oldest point, ``back`` from the newest (1).
    """
    by_day = Window.partitionBy(key).orderBy(*order)
    down = Window.partitionBy(key)
    price = F.col("price").cast("double")
    previous = F.lag(price).over(by_day)
    rows = (
        series.withColumn("price", price)
        .withColumn("_previous", previous)
        .filter(F.coalesce(F.col("_previous") != 0, F.lit(True)))
    )
    return (
        rows.withColumn("returns", F.coalesce(ratio(F.col("price"), F.col("_previous")) - 1, F.lit(0.0)))
        .withColumn("log_returns", F.coalesce(F.ln(ratio(F.col("price"), F.col("_previous"))), F.lit(0.0)))
        .withColumn("ord", F.row_number().over(by_day))
        .withColumn("n", F.count("*").over(down))
        .withColumn("back", F.col("n") - F.col("ord") + 1)
        .drop("_previous")
    )


def first_price() -> Column:
    return F.max(F.when(F.col("ord") == 1, F.col("price")))


def last_price() -> Column:
    return F.max(F.when(F.col("back") == 1, F.col("price")))


def _days() -> Column:
    return F.datediff(F.max("price_date"), F.min("price_date"))


def returns_columns() -> list[Column]:
    """Total return, CAGR, volatility, best and worst day (percent)."""
    years = F.greatest(_days() / fixed.DAYS_PER_YEAR, F.lit(1 / fixed.DAYS_PER_YEAR))
    std = F.stddev_samp("returns")
    return [
        half_up((ratio(last_price(), first_price()) - 1) * 100, 2).alias("total_return"),
        half_up((F.pow(ratio(last_price(), first_price()), 1 / years) - 1) * 100, 2).alias("cagr"),
        half_up(std * ANNUAL * 100, 2).alias("annualized_volatility"),
        half_up(F.avg("returns") * 100, 4).alias("daily_return_avg"),
        half_up(std * 100, 2).alias("daily_volatility"),
        F.round(years, 2).alias("years_held"),
        _days().cast("bigint").alias("days_held"),
        half_up(F.max("returns") * 100, 2).alias("best_single_day"),
        half_up(F.min("returns") * 100, 2).alias("worst_single_day"),
    ]


def returns_summary(points: DataFrame, key: str = "product_id") -> DataFrame:
    return _gate(points, "returns").groupBy(key).agg(*returns_columns())


def with_drawdown(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Running peak (its first occurrence), drawdown, and the first deepest trough.

    ``peak`` and ``trough`` are structs; the peak of the trough is the peak the
    drawdown is measured from.
    """
    so_far = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    peak = F.max(F.struct("price", (-F.col("ord")).alias("neg_ord"), "price_date")).over(so_far)
    rows = points.withColumn("peak", peak).withColumn(
        "drawdown", ratio(F.col("price") - F.col("peak.price"), F.col("peak.price"))
    )
    trough = F.min(
        F.struct(
            "drawdown", "ord", "price_date",
            F.col("peak.price").alias("peak_price"), F.col("peak.price_date").alias("peak_date"),
        )
    ).over(whole)
    return rows.withColumn("trough", trough)


def drawdown_columns() -> list[Column]:
    """Deepest drawdown, its length in days, and days until the peak is reached again."""
    recovered = (F.col("ord") >= F.col("trough.ord")) & (F.col("price") >= F.col("trough.peak_price"))
    # the trough is the same on every row of a product
    trough = {f: F.max(f"trough.{f}") for f in ("drawdown", "ord", "price_date", "peak_date")}
    back_at = F.min(F.when(recovered, F.col("price_date")))
    return [
        half_up(trough["drawdown"] * 100, 2).alias("max_drawdown_pct"),
        F.datediff(trough["price_date"], trough["peak_date"]).cast("bigint").alias("max_drawdown_duration_days"),
        F.when(trough["ord"] < F.max("n"), F.datediff(back_at, trough["price_date"]))
        .cast("bigint").alias("recovery_to_peak_days"),
    ]


def drawdown(points: DataFrame, key: str = "product_id") -> DataFrame:
    return _gate(with_drawdown(points, key), "risk").groupBy(key).agg(*drawdown_columns())


def ratio_columns(risk_free: float = fixed.RISK_FREE_RATE) -> list[Column]:
    """Sharpe, Sortino, Calmar, downside deviation and mean up / down return."""
    mean, std = F.avg("returns"), F.stddev_samp("returns")
    losses = F.when(F.col("returns") < 0, F.col("returns"))
    gains = F.when(F.col("returns") > 0, F.col("returns"))
    downside = F.stddev_samp(losses) * ANNUAL
    deepest = F.min("drawdown")
    growth = F.pow(
        ratio(last_price(), first_price()), F.try_divide(F.lit(fixed.DAYS_PER_YEAR), _days())
    ) - 1
    return [
        half_up(
            F.when(std > 0, (mean - risk_free / fixed.DAYS_PER_YEAR) / std * ANNUAL).otherwise(0.0), 3
        ).alias("sharpe_ratio"),
        half_up(
            F.when(downside > 0, (mean * fixed.DAYS_PER_YEAR - risk_free) / downside).otherwise(0.0), 3
        ).alias("sortino_ratio"),
        half_up(F.when(deepest < 0, growth / F.abs(deepest)).otherwise(0.0), 3).alias("calmar_ratio"),
        half_up(F.when(F.count(losses) == 0, 0.0).otherwise(downside * 100), 2).alias("downside_deviation"),
        half_up(F.coalesce(F.avg(gains), F.lit(0.0)) * 100, 2).alias("upside_capture"),
        half_up(F.coalesce(F.avg(losses), F.lit(0.0)) * 100, 2).alias("downside_capture"),
    ]


def risk_ratios(points: DataFrame, key: str = "product_id", risk_free: float = fixed.RISK_FREE_RATE) -> DataFrame:
    return _gate(with_drawdown(points, key), "risk").groupBy(key).agg(*ratio_columns(risk_free))


def performance_columns() -> list[Column]:
    """Win rate, mean win and loss, profit factor, consistency, stability."""
    wins = F.when(F.col("returns") > 0, F.col("returns"))
    losses = F.when(F.col("returns") < 0, F.col("returns"))
    total = F.count("returns")
    mean = F.avg("returns")
    return [
        half_up(F.count(wins) / total * 100, 2).alias("win_rate_pct"),
        half_up(F.coalesce(F.avg(wins), F.lit(0.0)) * 100, 2).alias("avg_win_pct"),
        half_up(F.coalesce(F.avg(losses), F.lit(0.0)) * 100, 2).alias("avg_loss_pct"),
        half_up(
            F.when(F.count(losses) > 0, F.abs(ratio(F.coalesce(F.sum(wins), F.lit(0.0)), F.sum(losses))))
            .otherwise(999.0), 2
        ).alias("profit_factor"),
        half_up(
            F.when(mean != 0, 1 - ratio(F.stddev_samp("returns"), F.abs(mean))).otherwise(0.0), 3
        ).alias("return_consistency"),
        half_up(1 - ratio(F.stddev_samp("price"), F.avg("price")), 3).alias("price_stability"),
        F.count(wins).alias("winning_periods"),
        (total - F.count(wins)).alias("losing_periods"),
        total.alias("total_periods"),
    ]


def performance(points: DataFrame, key: str = "product_id") -> DataFrame:
    return _gate(points, "performance").groupBy(key).agg(*performance_columns())


# -- technical ---------------------------------------------------------------------------


def rolling_averages(points: DataFrame, key: str = "product_id") -> DataFrame:
    """SMA 10 / 20 and Bollinger bands at every point (NULL until the frame is full)."""
    def frame(size: int):
        return Window.partitionBy(key).orderBy(*ORDER).rowsBetween(1 - size, 0)

    def full(size: int, value: Column) -> Column:
        return F.when(F.col("ord") >= size, value)

    middle = full(20, F.avg("price").over(frame(20)))
    spread = full(20, F.stddev_samp("price").over(frame(20)))
    return (
        points.withColumn("sma_10", full(10, F.avg("price").over(frame(10))))
        .withColumn("sma_20", middle)
        .withColumn("_spread", spread)
        .withColumn("upper_band", F.col("sma_20") + 2 * F.col("_spread"))
        .withColumn("lower_band", F.col("sma_20") - 2 * F.col("_spread"))
        .drop("_spread")
    )


def with_change(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Price change against the previous point."""
    by_day = Window.partitionBy(key).orderBy(*ORDER)
    return points.withColumn("change", F.col("price") - F.lag("price").over(by_day))


def _newest(size: int, value: Column) -> Column:
    return F.when(F.col("back") <= size, value)


def ema(span: int) -> Column:
    """Last value of the exponential mean with weights over the whole history."""
    keep = 1 - 2 / (span + 1)
    weight = F.pow(F.lit(keep), (F.col("back") - 1).cast("double"))
    return F.sum(F.col("price") * weight) / F.sum(weight)


def average_columns() -> list[Column]:
    """Newest SMA 10 / 20 and EMA 10 / 20."""
    return [
        F.avg(_newest(10, F.col("price"))).alias("sma_10"),
        F.avg(_newest(20, F.col("price"))).alias("sma_20"),
        ema(10).alias("ema_10"),
        ema(20).alias("ema_20"),
        F.stddev_samp(_newest(20, F.col("price"))).alias("std_20"),
        last_price().alias("current_price"),
    ]


def rsi() -> Column:
    """RSI 14 with simple means; NULL when there was no change at all."""
    gain = F.avg(_newest(14, F.greatest(F.col("change"), F.lit(0.0))))
    loss = F.avg(_newest(14, F.greatest(-F.col("change"), F.lit(0.0))))
    return 100 * ratio(gain, gain + loss)


def momentum(size: int) -> Column:
    """Percent against the value ``size - 1`` points back."""
    return (ratio(last_price(), F.max(F.when(F.col("back") == size, F.col("price")))) - 1) * 100


def technical_indicators(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Signals of the newest point: averages, Bollinger, RSI, momentum. Needs 20 points."""
    raw = (
        _gate(with_change(points, key), "technical")
        .groupBy(key)
        .agg(*average_columns(), rsi().alias("_rsi"), momentum(10).alias("_m10"), momentum(20).alias("_m20"))
    )
    return raw.select(key, *_technical_from_raw())


def _technical_from_raw() -> list[Column]:
    price = F.col("current_price")

    def signal(average: str) -> Column:
        return F.when(price > F.col(average), "bullish").otherwise("bearish").alias(f"{average}_signal")

    lower = F.col("sma_20") - F.col("std_20") * 2
    upper = F.col("sma_20") + F.col("std_20") * 2
    place = ratio(price - lower, upper - lower)
    strength = F.abs(F.col("_m20"))
    return [
        *[signal(a) for a in ("sma_10", "sma_20", "ema_10", "ema_20")],
        half_up(place, 3).alias("bollinger_position"),
        F.when(place > 0.8, "overbought").when(place < 0.2, "oversold").otherwise("neutral").alias("bollinger_signal"),
        half_up(F.coalesce(F.col("_rsi"), F.lit(50.0)), 2).alias("rsi_current"),
        F.when(F.col("_rsi") > 70, "overbought").when(F.col("_rsi") < 30, "oversold")
        .otherwise("neutral").alias("rsi_signal"),
        half_up(F.col("_m10"), 2).alias("momentum_10d_pct"),
        half_up(F.col("_m20"), 2).alias("momentum_20d_pct"),
        F.when(strength > 10, "strong").when(strength > 5, "moderate").otherwise("weak").alias("trend_strength"),
    ]


# -- tails and distribution -----------------------------------------------------------------


def with_tails(points: DataFrame, key: str = "product_id") -> DataFrame:
    """5 %, 1 % and 50 % percentiles of the product's returns, on every row."""
    whole = Window.partitionBy(key)
    levels = points.withColumn("_levels", F.percentile("returns", [0.05, 0.01, 0.5]).over(whole))
    return levels.withColumns({
        "_var_95": F.col("_levels")[0], "_var_99": F.col("_levels")[1], "_median_return": F.col("_levels")[2],
    }).drop("_levels")


def var_columns() -> list[Column]:
    """Historical, parametric and money value at risk, expected shortfall."""
    mean, std = F.avg("returns"), F.stddev_samp("returns")
    columns = []
    for level, z in (("95", fixed.Z_95), ("99", fixed.Z_99)):
        limit = F.max(f"_var_{level}")
        tail = F.avg(F.when(F.col("returns") <= F.col(f"_var_{level}"), F.col("returns")))
        columns += [
            half_up(limit * 100, 2).alias(f"var_{level}_pct"),
            half_up((mean + z * std) * 100, 2).alias(f"parametric_var_{level}_pct"),
            half_up(F.coalesce(tail, F.lit(0.0)) * 100, 2).alias(f"expected_shortfall_{level}_pct"),
            half_up(last_price() * limit, 2).alias(f"dollar_var_{level}"),
        ]
    return columns


def value_at_risk(points: DataFrame, key: str = "product_id") -> DataFrame:
    return with_tails(_gate(points, "var"), key).groupBy(key).agg(*var_columns())


def with_previous_return(points: DataFrame, key: str = "product_id") -> DataFrame:
    by_day = Window.partitionBy(key).orderBy(*ORDER)
    return points.withColumn("_previous_return", F.lag("returns").over(by_day))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of the rows that have both values; NULL when one is constant.

    (``corr`` raises on a constant column in ANSI mode.)
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def distribution_columns() -> list[Column]:
    """Moments of the returns, Jarque-Bera p value, lag-1 autocorrelation, class."""
    skew, kurt = F.skewness("returns"), F.kurtosis("returns")
    p_value = F.exp(-(F.count("returns") / 6 * (skew * skew + kurt * kurt / 4)) / 2)
    normal = F.coalesce(p_value > 0.05, F.lit(False))
    return [
        half_up(F.avg("returns") * 100, 4).alias("mean_return_pct"),
        half_up(F.max("_median_return") * 100, 4).alias("median_return_pct"),
        half_up(F.stddev_samp("returns") * 100, 2).alias("std_return_pct"),
        half_up(skew, 3).alias("skewness"),
        half_up(kurt, 3).alias("kurtosis"),
        normal.alias("is_normal_distribution"),
        F.round(p_value, 4).alias("jarque_bera_pvalue"),
        half_up(correlation("returns", "_previous_return"), 3).alias("autocorrelation_lag1"),
        F.when(normal, "normal").when(kurt > 3, "fat-tailed").otherwise("thin-tailed").alias("distribution_type"),
    ]


def return_distribution(points: DataFrame, key: str = "product_id") -> DataFrame:
    rows = with_tails(with_previous_return(_gate(points, "distribution"), key), key)
    return rows.groupBy(key).agg(*distribution_columns())


# -- seasonality and timing --------------------------------------------------------------------


def with_rolling_spread(points: DataFrame, key: str = "product_id") -> DataFrame:
    """10-point rolling deviation of the returns (NULL until the frame is full)."""
    frame = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(-9, 0)
    return points.withColumn(
        "_rolling_std", F.when(F.col("ord") >= 10, F.stddev_samp("returns").over(frame))
    )


def _period_means(part: Column, last: int) -> Column:
    """Array of (mean return, period) for the periods that occur."""
    means = [
        F.struct(
            F.avg(F.when(part == i, F.col("returns"))).alias("mean"), F.lit(i).alias("period")
        )
        for i in range(1, last + 1)
    ]
    return F.filter(F.array(*means), lambda s: s["mean"].isNotNull())


def _spread(means: Column) -> Column:
    """Sample deviation over the means of an array of structs."""
    values = F.transform(means, lambda s: s["mean"])
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(square, n - 1))


def seasonality(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Best and worst month and quarter, deviation across them, volatility clustering."""
    raw = (
        _gate(with_rolling_spread(points, key), "seasonality")
        .groupBy(key)
        .agg(*_seasonality_raw())
    )
    return raw.select(key, *_seasonality_from_raw())


def _seasonality_raw() -> list[Column]:
    return [
        _period_means(F.month("price_date"), 12).alias("_months"),
        _period_means(F.quarter("price_date"), 4).alias("_quarters"),
        F.stddev_samp("_rolling_std").alias("_clustering"),
        F.count("*").alias("_n"),
    ]


def _seasonality_from_raw() -> list[Column]:
    def best(name: str) -> Column:
        # lowest period among equal means
        turned = F.transform(F.col(name), lambda s: F.struct(s["mean"].alias("mean"), (-s["period"]).alias("p")))
        return (-F.array_max(turned)["p"]).cast("bigint")

    def worst(name: str) -> Column:
        return F.array_min(F.col(name))["period"].cast("bigint")

    return [
        best("_months").alias("best_month"),
        worst("_months").alias("worst_month"),
        best("_quarters").alias("best_quarter"),
        worst("_quarters").alias("worst_quarter"),
        half_up(_spread(F.col("_months")) * 100, 2).alias("monthly_volatility"),
        half_up(_spread(F.col("_quarters")) * 100, 2).alias("quarterly_volatility"),
        half_up(F.col("_clustering"), 4).alias("volatility_clustering"),
        F.when(F.col("_n") > 100, "daily").when(F.col("_n") > 20, "weekly").otherwise("monthly").alias("data_frequency"),
    ]


def with_range(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Support and resistance: quartiles of the newest 90 prices, on every row."""
    levels = F.percentile(_newest(90, F.col("price")), [0.25, 0.75]).over(Window.partitionBy(key))
    return points.withColumn("_range", levels).withColumns({
        "_low_quartile": F.col("_range")[0], "_high_quartile": F.col("_range")[1],
    }).drop("_range")


def _timing_raw() -> list[Column]:
    columns = []
    for size in (30, 90):
        near = _newest(size, F.col("price"))
        columns += [F.min(near).alias(f"_low_{size}"), F.max(near).alias(f"_high_{size}")]
    return columns + [
        F.max("_low_quartile").alias("_support"),
        F.max("_high_quartile").alias("_resistance"),
        last_price().alias("_now"),
    ]


def _timing_from_raw() -> list[Column]:
    now, support, resistance = F.col("_now"), F.col("_support"), F.col("_resistance")

    def position(size: int) -> Column:
        low, high = F.col(f"_low_{size}"), F.col(f"_high_{size}")
        return F.coalesce(ratio(now - low, high - low), F.lit(0.5))

    place = position(90)
    return [
        half_up(position(30), 3).alias("position_30d_range"),
        half_up(place, 3).alias("position_90d_range"),
        half_up(support, 2).alias("support_level"),
        half_up(resistance, 2).alias("resistance_level"),
        F.when(place < 0.3, "buy").when(place > 0.7, "sell").otherwise("hold").alias("entry_signal"),
        half_up(ratio(now - support, support) * 100, 2).alias("distance_to_support_pct"),
        half_up(ratio(resistance - now, now) * 100, 2).alias("distance_to_resistance_pct"),
        half_up(1 - place, 2).alias("market_timing_score"),
    ]


def market_timing(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Place of the newest price in its recent range, support, resistance, entry signal."""
    raw = with_range(_gate(points, "timing"), key).groupBy(key).agg(*_timing_raw())
    return raw.select(key, *_timing_from_raw())


# -- bundle ---------------------------------------------------------------------------------------


def _gate(points: DataFrame, block: str) -> DataFrame:
    return points.filter(F.col("n") >= BLOCK_GATES[block])


def metric_bundle(series: DataFrame, key: str = "product_id", risk_free: float = fixed.RISK_FREE_RATE) -> DataFrame:
    """Every block as one struct column per product; a block is NULL below its gate.

    One exchange, one sort and one aggregate for all eight blocks. Percentiles are window
    values of the product's points, so the aggregate itself holds plain numbers only.
    """
    points = with_returns(series, key)
    points = with_rolling_spread(with_previous_return(with_change(with_drawdown(points, key), key), key), key)
    points = with_range(with_tails(_gate(points, "returns"), key), key)
    raw = points.groupBy(key).agg(
        F.count("*").alias("total_points"),
        F.min("price_date").alias("start_date"),
        F.max("price_date").alias("end_date"),
        F.struct(*returns_columns()).alias("returns_analysis"),
        F.struct(*ratio_columns(risk_free), *drawdown_columns()).alias("risk_metrics"),
        F.struct(*performance_columns()).alias("performance_metrics"),
        F.struct(*var_columns()).alias("_var"),
        F.struct(*distribution_columns()).alias("_distribution"),
        *average_columns(),
        rsi().alias("_rsi"), momentum(10).alias("_m10"), momentum(20).alias("_m20"),
        *_seasonality_raw(),
        *_timing_raw(),
    )

    def gated(block: str, value: Column, name: str) -> Column:
        return F.when(F.col("total_points") >= BLOCK_GATES[block], value).alias(name)

    return raw.select(
        key, "total_points", "start_date", "end_date",
        "returns_analysis", "risk_metrics", "performance_metrics",
        gated("technical", F.struct(*_technical_from_raw()), "technical_indicators"),
        gated("var", F.col("_var"), "value_at_risk"),
        gated("distribution", F.col("_distribution"), "statistical_properties"),
        gated("seasonality", F.struct(*_seasonality_from_raw()), "time_series_analysis"),
        gated("timing", F.struct(*_timing_from_raw()), "market_timing"),
    )


# -- simple statistics (v1) -------------------------------------------------------------------------


def trend_thirds(series: DataFrame, key: str = "product_id") -> DataFrame:
    """Mean of the first against the last third of the points; stable below three points."""
    points = with_returns(series, key)
    third = F.floor(F.col("n") / 3)
    raw = points.groupBy(key).agg(
        F.count("*").alias("chronological_sample"),
        F.avg(F.when(F.col("ord") <= third, F.col("price"))).alias("_early"),
        F.avg(F.when(F.col("back") <= third, F.col("price"))).alias("_late"),
    )
    return raw.select(key, "chronological_sample", *_trend_from_raw())


def _trend_from_raw() -> list[Column]:
    early, late = F.col("_early"), F.col("_late")
    return [
        F.when(early.isNull(), "stable").when(late > early, "rising").otherwise("falling").alias("trend_direction"),
        half_up(
            F.coalesce(F.when(early > 0, F.abs(late - early) / early), F.lit(0.0)) * 100, 2
        ).alias("trend_strength"),
    ]


def basic_analysis(series: DataFrame, key: str = "product_id") -> DataFrame:
    """Mean, range, population volatility, trend by thirds and position, one row per product."""
    points = with_returns(series, key)
    third = F.floor(F.col("n") / 3)
    mean = F.avg("price")
    raw = points.groupBy(key).agg(
        F.count("*").alias("sample_size"),
        F.min("price_date").alias("start_date"),
        F.max("price_date").alias("end_date"),
        F.countDistinct("source").alias("source_count"),
        half_up(mean, 2).alias("average"),
        F.min("price").alias("minimum"),
        F.max("price").alias("maximum"),
        half_up(F.stddev_pop("price"), 2).alias("volatility"),
        half_up(ratio(F.stddev_pop("price"), mean) * 100, 2).alias("volatility_percent"),
        half_up(ratio(mean, F.max("price")) * 100, 2).alias("current_vs_max"),
        half_up(ratio(mean, F.min("price")) * 100, 2).alias("current_vs_min"),
        F.avg(F.when(F.col("ord") <= third, F.col("price"))).alias("_early"),
        F.avg(F.when(F.col("back") <= third, F.col("price"))).alias("_late"),
    )
    days = F.datediff("end_date", "start_date")
    quality = (
        steps(F.col("sample_size"), fixed.VOLUME_POINTS, 0)
        + F.when(F.col("source_count") >= 2, 30).when(F.col("source_count") == 1, 15).otherwise(0)
        + steps(days, fixed.SPAN_POINTS, 0)
    )
    return raw.select(
        *[c for c in raw.columns if not c.startswith("_")],
        *_trend_from_raw(),
        days.cast("bigint").alias("date_range_days"),
        F.least(F.lit(1.0), quality / 100).alias("quality_score"),
    )


def source_breakdown(series: DataFrame, key: str = "product_id") -> DataFrame:
    """Count, mean and range per product and source."""
    return series.groupBy(key, "source").agg(
        F.count("*").alias("count"),
        half_up(F.avg("price"), 2).alias("average"),
        half_up(F.min("price"), 2).alias("range_low"),
        half_up(F.max("price"), 2).alias("range_high"),
    )

