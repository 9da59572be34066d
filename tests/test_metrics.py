"""Metric blocks against a plain pandas / numpy recomputation on seeded price paths."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from gavelwork.operators import decide, metrics, portfolio

# (start price, annual trend, annual volatility, days)
SCENARIOS = {
    "strong": (100, 0.15, 0.08, 365), "volatile": (50, 0.25, 0.25, 730),
    "stable": (150, 0.08, 0.05, 365), "declining": (200, -0.10, 0.15, 365),
}
END = dt.date(2025, 6, 30)


def path(start, trend, volatility, days):
    rng = np.random.RandomState(42)
    steps = rng.normal(trend / 365, volatility / math.sqrt(365), days)
    prices = start * np.concatenate([[1.0], np.cumprod(1 + steps)])
    dates = [END - dt.timedelta(days=days - i) for i in range(days + 1)]
    return pd.DataFrame({"price_date": dates, "price": np.round(prices, 2)})


PATHS = {name: path(*args) for name, args in SCENARIOS.items()}
PATHS["short"] = PATHS["strong"].head(5)
PATHS["single"] = PATHS["strong"].head(1)
PATHS["flat"] = PATHS["strong"].head(40).assign(price=10.0)


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        (name, r.price_date, float(r.price), "ebay", "raw") for name, p in PATHS.items() for r in p.itertuples()
    ]
    return spark.createDataFrame(
        rows, "product_id string, price_date date, price double, source string, condition_category string"
    )


@pytest.fixture(scope="module")
def bundle(series):
    return {r.product_id: r for r in metrics.metric_bundle(series).collect()}


def test_gates(bundle):
    assert "single" not in bundle
    assert bundle["short"].value_at_risk is None
    assert bundle["short"].technical_indicators is None
    assert bundle["short"].returns_analysis is not None
    assert bundle["flat"].time_series_analysis is not None


@pytest.mark.parametrize("name", list(SCENARIOS))
def test_returns_and_risk(bundle, name):
    p = PATHS[name].price
    r = p.pct_change().fillna(0)
    days = len(p) - 1
    got = bundle[name]
    assert got.returns_analysis.total_return == pytest.approx((p.iloc[-1] / p.iloc[0] - 1) * 100, abs=0.006)
    assert got.returns_analysis.cagr == pytest.approx(((p.iloc[-1] / p.iloc[0]) ** (365.25 / days) - 1) * 100, abs=0.006)
    assert got.returns_analysis.annualized_volatility == pytest.approx(r.std() * math.sqrt(365.25) * 100, abs=0.006)
    assert got.risk_metrics.sharpe_ratio == pytest.approx(
        (r.mean() - 0.045 / 365.25) / r.std() * math.sqrt(365.25), abs=0.0006)
    fall = (p - p.cummax()) / p.cummax()
    assert got.risk_metrics.max_drawdown_pct == pytest.approx(fall.min() * 100, abs=0.006)
    end, start = fall.idxmin(), p[: fall.idxmin() + 1].idxmax()
    assert got.risk_metrics.max_drawdown_duration_days == end - start
    back = p[end:][p[end:] >= p[start]]
    assert got.risk_metrics.recovery_to_peak_days == (back.index[0] - end if len(back) else None)
    losses = r[r < 0]
    assert got.risk_metrics.sortino_ratio == pytest.approx(
        (r.mean() * 365.25 - 0.045) / (losses.std() * math.sqrt(365.25)), abs=0.0006)


@pytest.mark.parametrize("name", list(SCENARIOS))
def test_technical(bundle, name):
    p = PATHS[name].price
    got = bundle[name].technical_indicators
    now = p.iloc[-1]

    def word(mean):
        return "bullish" if now > mean else "bearish"

    assert got.sma_20_signal == word(p.rolling(20).mean().iloc[-1])
    assert got.ema_10_signal == word(p.ewm(span=10).mean().iloc[-1])
    assert got.ema_20_signal == word(p.ewm(span=20).mean().iloc[-1])
    change = p.diff()
    gain = change.where(change > 0, 0).rolling(14).mean().iloc[-1]
    loss = (-change.where(change < 0, 0)).rolling(14).mean().iloc[-1]
    assert got.rsi_current == pytest.approx(100 - 100 / (1 + gain / loss), abs=0.006)
    mid, dev = p.rolling(20).mean().iloc[-1], p.rolling(20).std().iloc[-1]
    assert got.bollinger_position == pytest.approx((now - mid + 2 * dev) / (4 * dev), abs=0.0006)
    assert got.momentum_10d_pct == pytest.approx((now / p.iloc[-10] - 1) * 100, abs=0.006)


@pytest.mark.parametrize("name", list(SCENARIOS))
def test_tails_distribution_timing(bundle, name):
    p = PATHS[name].price
    r = p.pct_change().fillna(0)
    got = bundle[name]
    v = np.percentile(r, 5)
    assert got.value_at_risk.var_95_pct == pytest.approx(v * 100, abs=0.006)
    assert got.value_at_risk.expected_shortfall_95_pct == pytest.approx(r[r <= v].mean() * 100, abs=0.006)
    d = r - r.mean()
    skew = (d**3).mean() / (d**2).mean() ** 1.5
    kurt = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert got.statistical_properties.skewness == pytest.approx(skew, abs=0.0006)
    assert got.statistical_properties.kurtosis == pytest.approx(kurt, abs=0.0006)
    assert got.statistical_properties.autocorrelation_lag1 == pytest.approx(r.autocorr(1), abs=0.0006)
    last = p.iloc[-90:]
    assert got.market_timing.support_level == pytest.approx(last.quantile(0.25), abs=0.006)
    assert got.market_timing.position_90d_range == pytest.approx(
        (p.iloc[-1] - last.min()) / (last.max() - last.min()), abs=0.0006)
    months = r.groupby(pd.to_datetime(PATHS[name].price_date).dt.month).mean()
    assert got.time_series_analysis.best_month == months.idxmax()
    assert got.time_series_analysis.monthly_volatility == pytest.approx(months.std() * 100, abs=0.006)
    assert got.time_series_analysis.volatility_clustering == pytest.approx(r.rolling(10).std().std(), abs=0.00006)


def test_flat_series(bundle):
    got = bundle["flat"]
    assert got.risk_metrics.sharpe_ratio == 0
    assert got.performance_metrics.profit_factor == 999
    assert got.technical_indicators.rsi_current == 50
    assert got.technical_indicators.rsi_signal == "neutral"
    assert got.market_timing.position_90d_range == 0.5


def test_grades(series):
    rows = {r.product_id: r for r in decide.investment_grade(metrics.metric_bundle(series)).collect()}
    assert rows["declining"].score <= rows["strong"].score
    assert all(0 <= r.score <= 100 and len(r.reasoning) == 4 for r in rows.values())
    # no technical block: the absent RSI still counts as one signal
    assert rows["short"].reasoning[3] == "Weak technical indicators"


def test_combined_verdict(spark):
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame(
        [("BUY", "STRONG_BUY"), ("BUY", "SELL"), ("AVOID", "SELL"), ("HOLD", "x"), ("AVOID", "AVOID")], "a string, b string"
    )
    got = [r.v for r in pairs.select(decide.combined_verdict(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == ["STRONG_BUY", "HOLD", "SELL", "HOLD", "STRONG_SELL"]


def test_portfolio(series):
    members = series.filter("product_id IN ('strong', 'stable', 'declining', 'volatile')")
    k = 366
    returns = {n: PATHS[n].price.pct_change().fillna(0).to_numpy()[-k:] for n in sorted(SCENARIOS)}
    matrix = np.corrcoef(np.array(list(returns.values())))
    names = list(returns)
    pairs = {(r.name_a, r.name_b): r.correlation for r in portfolio.correlation_pairs(members).collect()}
    assert len(pairs) == 6
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            assert pairs[a, names[j]] == pytest.approx(matrix[i, j], abs=0.0001)
    total = portfolio.portfolio_metrics(members).first()
    assert total.avg_correlation == pytest.approx(matrix[np.triu_indices(4, 1)].mean(), abs=0.0006)
    assert total.portfolio_volatility == pytest.approx(
        np.std(np.mean(list(returns.values()), axis=0)) * math.sqrt(365.25) * 100, abs=0.006)
    assert total.products_count == 4


def test_portfolio_needs_two(series):
    assert portfolio.portfolio_metrics(series.filter("product_id = 'strong'")).count() == 0
