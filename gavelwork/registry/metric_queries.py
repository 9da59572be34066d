"""Return, risk, technical, tail and timing metrics; grades, verdicts, portfolios."""

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators import decide, metrics, portfolio
from gavelwork.operators.series import daily_median_series
from gavelwork.plans import analysis
from gavelwork.registry.base import (
    AS_OF, EVENT_SERIES, LISTINGS, POINTS, SERIES, as_of, daily_series, day, days_as_text, div, hu, query, quoted,
    set_name, stamp, when, with_,
)
from gavelwork.registry.series_queries import event_series
from gavelwork.rules import fixed
from gavelwork.sources import starviews as views

BASE = (LISTINGS, SERIES, POINTS)
ANNUAL = repr(metrics.ANNUAL)
YEAR = repr(fixed.DAYS_PER_YEAR)
FIRST = "max(CASE WHEN ord = 1 THEN price END)"
LAST = "max(CASE WHEN back = 1 THEN price END)"
SPAN = "date_diff('day', min(price_date), max(price_date))"


def points(spark, sf_dir):
    return metrics.with_returns(daily_series(spark, sf_dir))


@query("return_points", with_(*BASE) + f"""
SELECT product_id, {day('price_date')} AS price_date, source, condition_category, ord, n,
  {hu('returns', 6)} AS returns, {hu('log_returns', 6)} AS log_returns FROM points""")
def return_points(spark, sf_dir):
    rows = points(spark, sf_dir)
    return days_as_text(rows.select(
        "product_id", "price_date", "source", "condition_category", F.col("ord").cast("bigint").alias("ord"), "n",
        half_up(F.col("returns"), 6).alias("returns"), half_up(F.col("log_returns"), 6).alias("log_returns"),
    ))


_YEARS = f"greatest({SPAN} / {YEAR}, 1 / {YEAR})"
RETURNS_SQL = f"""
  {hu(f'({LAST} / {FIRST} - 1) * 100', 2)} AS total_return,
  {hu(f'(pow({LAST} / {FIRST}, 1 / {_YEARS}) - 1) * 100', 2)} AS cagr,
  {hu(f'stddev_samp(returns) * {ANNUAL} * 100', 2)} AS annualized_volatility,
  {hu('avg(returns) * 100', 4)} AS daily_return_avg,
  {hu('stddev_samp(returns) * 100', 2)} AS daily_volatility,
  round({_YEARS}, 2) AS years_held,
  {SPAN} AS days_held,
  {hu('max(returns) * 100', 2)} AS best_single_day,
  {hu('min(returns) * 100', 2)} AS worst_single_day"""


@query("returns_summary", with_(*BASE) + f"""
SELECT product_id, {RETURNS_SQL} FROM points WHERE n >= 2 GROUP BY product_id""")
def returns_summary(spark, sf_dir):
    return metrics.returns_summary(points(spark, sf_dir))


DRAWDOWN = """
peaks AS (
  SELECT *, max(price) OVER (PARTITION BY product_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS peak FROM points
),
falls AS (SELECT *, (price - peak) / peak AS drawdown FROM peaks),
troughs AS (
  SELECT product_id, min(drawdown) AS deepest, arg_min(ord, (drawdown, ord)) AS t_ord,
    arg_min(price_date, (drawdown, ord)) AS t_date, arg_min(peak, (drawdown, ord)) AS t_peak
  FROM falls GROUP BY product_id
),
starts AS (
  SELECT t.product_id, min(p.price_date) AS p_date
  FROM troughs t JOIN points p ON p.product_id = t.product_id AND p.ord <= t.t_ord AND p.price = t.t_peak
  GROUP BY t.product_id
),
recoveries AS (
  SELECT t.product_id, min(p.price_date) AS r_date
  FROM troughs t JOIN points p ON p.product_id = t.product_id AND p.ord >= t.t_ord AND p.price >= t.t_peak
  GROUP BY t.product_id
)"""


@query("drawdown", with_(*BASE, DRAWDOWN) + f"""
SELECT t.product_id, {hu('deepest * 100', 2)} AS max_drawdown_pct,
  date_diff('day', p_date, t_date) AS max_drawdown_duration_days,
  CASE WHEN t_ord < n THEN date_diff('day', t_date, r_date) END AS recovery_to_peak_days
FROM troughs t JOIN starts USING (product_id) LEFT JOIN recoveries USING (product_id)
JOIN (SELECT DISTINCT product_id, n FROM points) USING (product_id) WHERE n >= 2""")
def drawdown(spark, sf_dir):
    return metrics.drawdown(points(spark, sf_dir))


RF = repr(fixed.RISK_FREE_RATE)
_DOWN = f"(stddev_samp(returns) FILTER (WHERE returns < 0) * {ANNUAL})"
_GROWTH = f"(pow({LAST} / {FIRST}, {div(YEAR, SPAN)}) - 1)"
RATIOS_SQL = f"""
  {hu(f'CASE WHEN stddev_samp(returns) > 0 THEN (avg(returns) - {RF} / {YEAR}) / stddev_samp(returns) * {ANNUAL} ELSE 0 END', 3)} AS sharpe_ratio,
  {hu(f'CASE WHEN {_DOWN} > 0 THEN (avg(returns) * {YEAR} - {RF}) / {_DOWN} ELSE 0 END', 3)} AS sortino_ratio,
  {hu(f'CASE WHEN min(drawdown) < 0 THEN {_GROWTH} / abs(min(drawdown)) ELSE 0 END', 3)} AS calmar_ratio,
  {hu(f'CASE WHEN count(*) FILTER (WHERE returns < 0) = 0 THEN 0 ELSE {_DOWN} * 100 END', 2)} AS downside_deviation,
  {hu('coalesce(avg(returns) FILTER (WHERE returns > 0), 0) * 100', 2)} AS upside_capture,
  {hu('coalesce(avg(returns) FILTER (WHERE returns < 0), 0) * 100', 2)} AS downside_capture"""


@query("risk_ratios", with_(*BASE, DRAWDOWN) + f"""
SELECT product_id, {RATIOS_SQL} FROM falls WHERE n >= 2 GROUP BY product_id""")
def risk_ratios(spark, sf_dir):
    return metrics.risk_ratios(points(spark, sf_dir))


PERFORMANCE_SQL = f"""
  {hu('count(*) FILTER (WHERE returns > 0) / count(*) * 100', 2)} AS win_rate_pct,
  {hu('coalesce(avg(returns) FILTER (WHERE returns > 0), 0) * 100', 2)} AS avg_win_pct,
  {hu('coalesce(avg(returns) FILTER (WHERE returns < 0), 0) * 100', 2)} AS avg_loss_pct,
  {hu('CASE WHEN count(*) FILTER (WHERE returns < 0) > 0 THEN abs(coalesce(sum(returns) FILTER (WHERE returns > 0), 0) / sum(returns) FILTER (WHERE returns < 0)) ELSE 999 END', 2)} AS profit_factor,
  {hu('CASE WHEN avg(returns) <> 0 THEN 1 - stddev_samp(returns) / abs(avg(returns)) ELSE 0 END', 3)} AS return_consistency,
  {hu('1 - stddev_samp(price) / avg(price)', 3)} AS price_stability,
  count(*) FILTER (WHERE returns > 0) AS winning_periods,
  count(*) - count(*) FILTER (WHERE returns > 0) AS losing_periods,
  count(*) AS total_periods"""


@query("performance", with_(*BASE) + f"""
SELECT product_id, {PERFORMANCE_SQL} FROM points WHERE n >= 2 GROUP BY product_id""")
def performance(spark, sf_dir):
    return metrics.performance(points(spark, sf_dir))


def _frame(size):
    return f"OVER (PARTITION BY product_id ORDER BY ord ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


@query("sma_bollinger", with_(*BASE) + f"""
SELECT product_id, ord, {hu('sma_10', 4)} AS sma_10, {hu('sma_20', 4)} AS sma_20,
  {hu('sma_20 + 2 * spread', 4)} AS upper_band, {hu('sma_20 - 2 * spread', 4)} AS lower_band
FROM (
  SELECT product_id, ord, CASE WHEN ord >= 10 THEN avg(price) {_frame(10)} END AS sma_10,
    CASE WHEN ord >= 20 THEN avg(price) {_frame(20)} END AS sma_20,
    CASE WHEN ord >= 20 THEN stddev_samp(price) {_frame(20)} END AS spread
  FROM points) WHERE sma_10 IS NOT NULL""")
def sma_bollinger(spark, sf_dir):
    rows = metrics.rolling_averages(points(spark, sf_dir)).filter(F.col("sma_10").isNotNull())
    names = ("sma_10", "sma_20", "upper_band", "lower_band")
    return rows.select(
        "product_id", F.col("ord").cast("bigint").alias("ord"), *[half_up(F.col(c), 4).alias(c) for c in names]
    )


def _ema(span):
    keep = repr(1 - 2 / (span + 1))
    return f"sum(price * pow({keep}, back - 1)) / sum(pow({keep}, back - 1))"


_CHANGES = """
changes AS (
  SELECT *, price - lag(price) OVER (PARTITION BY product_id ORDER BY ord) AS change FROM points
)"""
_TECH = f"""
tech AS (
  SELECT product_id, {LAST} AS now, avg(price) FILTER (WHERE back <= 10) AS sma_10,
    avg(price) FILTER (WHERE back <= 20) AS sma_20, stddev_samp(price) FILTER (WHERE back <= 20) AS std_20,
    {_ema(10)} AS ema_10, {_ema(20)} AS ema_20,
    avg(greatest(change, 0)) FILTER (WHERE back <= 14) AS gain,
    avg(greatest(-change, 0)) FILTER (WHERE back <= 14) AS loss,
    ({LAST} / max(price) FILTER (WHERE back = 10) - 1) * 100 AS m10,
    ({LAST} / max(price) FILTER (WHERE back = 20) - 1) * 100 AS m20
  FROM changes WHERE n >= 20 GROUP BY product_id
),
tech2 AS (
  SELECT *, (now - (sma_20 - 2 * std_20)) / nullif((sma_20 + 2 * std_20) - (sma_20 - 2 * std_20), 0) AS place,
    100 * gain / nullif(gain + loss, 0) AS rsi FROM tech
)"""


def _signal(average):
    return f"CASE WHEN now > {average} THEN 'bullish' ELSE 'bearish' END AS {average}_signal"


TECHNICAL_SQL = f"""
  {_signal('sma_10')}, {_signal('sma_20')}, {_signal('ema_10')}, {_signal('ema_20')},
  {hu('place', 3)} AS bollinger_position,
  CASE WHEN place > 0.8 THEN 'overbought' WHEN place < 0.2 THEN 'oversold' ELSE 'neutral' END AS bollinger_signal,
  {hu('coalesce(rsi, 50)', 2)} AS rsi_current,
  CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal,
  {hu('m10', 2)} AS momentum_10d_pct, {hu('m20', 2)} AS momentum_20d_pct,
  CASE WHEN abs(m20) > 10 THEN 'strong' WHEN abs(m20) > 5 THEN 'moderate' ELSE 'weak' END AS trend_strength"""


@query("technical_indicators", with_(*BASE, _CHANGES, _TECH) + f"""
SELECT product_id, {TECHNICAL_SQL} FROM tech2""")
def technical_indicators(spark, sf_dir):
    return metrics.technical_indicators(points(spark, sf_dir))


@query("ema_last", with_(*BASE, _CHANGES, _TECH) + f"""
SELECT product_id, {hu('ema_10', 4)} AS ema_10, {hu('ema_20', 4)} AS ema_20, {hu('sma_10', 4)} AS sma_10,
  {hu('sma_20', 4)} AS sma_20 FROM tech""")
def ema_last(spark, sf_dir):
    rows = points(spark, sf_dir).filter(F.col("n") >= 20).groupBy("product_id").agg(*metrics.average_columns())
    return rows.select("product_id", *[half_up(F.col(c), 4).alias(c) for c in ("ema_10", "ema_20", "sma_10", "sma_20")])


@query("rsi", with_(*BASE, _CHANGES, _TECH) + f"""
SELECT product_id, {hu('rsi', 4)} AS rsi FROM tech2""")
def rsi(spark, sf_dir):
    rows = metrics.with_change(points(spark, sf_dir)).filter(F.col("n") >= 20)
    return rows.groupBy("product_id").agg(half_up(metrics.rsi(), 4).alias("rsi"))


@query("momentum", with_(*BASE, _CHANGES, _TECH) + f"""
SELECT product_id, {hu('m10', 4)} AS momentum_10, {hu('m20', 4)} AS momentum_20 FROM tech""")
def momentum(spark, sf_dir):
    rows = points(spark, sf_dir).filter(F.col("n") >= 20)
    return rows.groupBy("product_id").agg(
        half_up(metrics.momentum(10), 4).alias("momentum_10"), half_up(metrics.momentum(20), 4).alias("momentum_20")
    )


_TAILS = """
tails AS (
  SELECT product_id, quantile_cont(returns, 0.05) AS v95, quantile_cont(returns, 0.01) AS v99
  FROM points WHERE n >= 10 GROUP BY product_id
)"""


def _var(level, z):
    return f"""
  {hu(f'max(v{level}) * 100', 2)} AS var_{level}_pct,
  {hu(f'(avg(returns) + {z!r} * stddev_samp(returns)) * 100', 2)} AS parametric_var_{level}_pct,
  {hu(f'coalesce(avg(returns) FILTER (WHERE returns <= v{level}), 0) * 100', 2)} AS expected_shortfall_{level}_pct,
  {hu(f'{LAST} * max(v{level})', 2)} AS dollar_var_{level}"""


@query("value_at_risk", with_(*BASE, _TAILS) + f"""
SELECT product_id, {_var('95', fixed.Z_95)}, {_var('99', fixed.Z_99)}
FROM points JOIN tails USING (product_id) GROUP BY product_id""")
def value_at_risk(spark, sf_dir):
    return metrics.value_at_risk(points(spark, sf_dir))


_MOMENTS = """
means AS (SELECT product_id, avg(returns) AS mu FROM points WHERE n >= 10 GROUP BY product_id),
shifted AS (
  SELECT p.product_id, returns, returns - mu AS d,
    lag(returns) OVER (PARTITION BY p.product_id ORDER BY ord) AS previous_return
  FROM points p JOIN means USING (product_id)
),
moments AS (
  SELECT product_id, count(*) AS n, avg(returns) AS mean, median(returns) AS med, stddev_samp(returns) AS std,
    avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurt,
    corr(returns, previous_return) AS auto
  FROM shifted GROUP BY product_id
),
moments2 AS (SELECT *, exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2) AS p FROM moments)"""


@query("return_distribution", with_(*BASE, _MOMENTS) + f"""
SELECT product_id, {hu('mean * 100', 4)} AS mean_return_pct, {hu('med * 100', 4)} AS median_return_pct,
  {hu('std * 100', 2)} AS std_return_pct, {hu('skew', 3)} AS skewness, {hu('kurt', 3)} AS kurtosis,
  coalesce(p > 0.05, false) AS is_normal_distribution, round(p, 4) AS jarque_bera_pvalue,
  {hu('auto', 3)} AS autocorrelation_lag1,
  CASE WHEN coalesce(p > 0.05, false) THEN 'normal' WHEN kurt > 3 THEN 'fat-tailed' ELSE 'thin-tailed' END AS distribution_type
FROM moments2""")
def return_distribution(spark, sf_dir):
    return metrics.return_distribution(points(spark, sf_dir))


_SEASON = """
rolling AS (
  SELECT product_id, n, CASE WHEN ord >= 10 THEN stddev_samp(returns) OVER (PARTITION BY product_id ORDER BY ord
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS spread FROM points WHERE n >= 30
),
clustering AS (SELECT product_id, max(n) AS n, stddev_samp(spread) AS c FROM rolling GROUP BY product_id),
months AS (SELECT product_id, month(price_date) AS k, avg(returns) AS m FROM points WHERE n >= 30 GROUP BY ALL),
quarters AS (SELECT product_id, quarter(price_date) AS k, avg(returns) AS m FROM points WHERE n >= 30 GROUP BY ALL),
by_month AS (SELECT product_id, arg_max(k, (m, -k)) AS best, arg_min(k, (m, k)) AS worst, stddev_samp(m) AS s FROM months GROUP BY 1),
by_quarter AS (SELECT product_id, arg_max(k, (m, -k)) AS best, arg_min(k, (m, k)) AS worst, stddev_samp(m) AS s FROM quarters GROUP BY 1)"""


@query("seasonality", with_(*BASE, _SEASON) + f"""
SELECT product_id, m.best AS best_month, m.worst AS worst_month, q.best AS best_quarter, q.worst AS worst_quarter,
  {hu('m.s * 100', 2)} AS monthly_volatility, {hu('q.s * 100', 2)} AS quarterly_volatility,
  {hu('c', 4)} AS volatility_clustering,
  CASE WHEN n > 100 THEN 'daily' WHEN n > 20 THEN 'weekly' ELSE 'monthly' END AS data_frequency
FROM by_month m JOIN by_quarter q USING (product_id) JOIN clustering USING (product_id)""")
def seasonality(spark, sf_dir):
    return metrics.seasonality(points(spark, sf_dir))


_TIMING = f"""
ranges AS (
  SELECT product_id, {LAST} AS now,
    min(price) FILTER (WHERE back <= 30) AS low30, max(price) FILTER (WHERE back <= 30) AS high30,
    min(price) FILTER (WHERE back <= 90) AS low90, max(price) FILTER (WHERE back <= 90) AS high90,
    quantile_cont(price, 0.25) FILTER (WHERE back <= 90) AS support,
    quantile_cont(price, 0.75) FILTER (WHERE back <= 90) AS resistance
  FROM points WHERE n >= 20 GROUP BY product_id
),
timing AS (
  SELECT *, coalesce((now - low30) / nullif(high30 - low30, 0), 0.5) AS place30,
    coalesce((now - low90) / nullif(high90 - low90, 0), 0.5) AS place90 FROM ranges
)"""


@query("market_timing", with_(*BASE, _TIMING) + f"""
SELECT product_id, {hu('place30', 3)} AS position_30d_range, {hu('place90', 3)} AS position_90d_range,
  {hu('support', 2)} AS support_level, {hu('resistance', 2)} AS resistance_level,
  CASE WHEN place90 < 0.3 THEN 'buy' WHEN place90 > 0.7 THEN 'sell' ELSE 'hold' END AS entry_signal,
  {hu('(now - support) / support * 100', 2)} AS distance_to_support_pct,
  {hu('(resistance - now) / now * 100', 2)} AS distance_to_resistance_pct,
  {hu('1 - place90', 2)} AS market_timing_score
FROM timing""")
def market_timing(spark, sf_dir):
    return metrics.market_timing(points(spark, sf_dir))


# -- bundle, grade, verdicts --------------------------------------------------------------------

_BLOCKS = f"""
r AS (SELECT product_id, count(*) AS total_points, min(price_date) AS start_date, max(price_date) AS end_date,
  {RETURNS_SQL} FROM points WHERE n >= 2 GROUP BY product_id),
k AS (SELECT product_id, {RATIOS_SQL}, {hu('min(drawdown) * 100', 2)} AS max_drawdown_pct FROM falls WHERE n >= 2 GROUP BY product_id),
f AS (SELECT product_id, {PERFORMANCE_SQL} FROM points WHERE n >= 2 GROUP BY product_id),
t AS (SELECT product_id, {TECHNICAL_SQL} FROM tech2),
g AS (SELECT product_id, CASE WHEN place90 < 0.3 THEN 'buy' WHEN place90 > 0.7 THEN 'sell' ELSE 'hold' END AS entry_signal FROM timing),
bundle AS (
  SELECT * FROM r JOIN k USING (product_id) JOIN f USING (product_id) LEFT JOIN t USING (product_id) LEFT JOIN g USING (product_id)
)"""
_BUNDLE = (*BASE, DRAWDOWN, _CHANGES, _TECH, _TIMING, _BLOCKS)


@query("metric_bundle", with_(*_BUNDLE) + f"""
SELECT product_id, total_points, {day('start_date')} AS start_date, {day('end_date')} AS end_date, total_return, cagr,
  annualized_volatility, sharpe_ratio, sortino_ratio, max_drawdown_pct, win_rate_pct, profit_factor,
  sma_20_signal, ema_20_signal, rsi_current, bollinger_position, entry_signal
FROM bundle""")
def metric_bundle(spark, sf_dir):
    rows = metrics.metric_bundle(daily_series(spark, sf_dir))
    return days_as_text(rows.select(
        "product_id", "total_points", "start_date", "end_date",
        *[f"returns_analysis.{c}" for c in ("total_return", "cagr", "annualized_volatility")],
        *[f"risk_metrics.{c}" for c in ("sharpe_ratio", "sortino_ratio", "max_drawdown_pct")],
        *[f"performance_metrics.{c}" for c in ("win_rate_pct", "profit_factor")],
        *[f"technical_indicators.{c}" for c in ("sma_20_signal", "ema_20_signal", "rsi_current", "bollinger_position")],
        "market_timing.entry_signal",
    ))


def _points(value, scale):
    return when([(f"{value} > {a}", str(p)) for a, p, _ in scale], "0")


_SIGNALS = """((coalesce(sma_20_signal = 'bullish', false))::INT + (coalesce(ema_20_signal = 'bullish', false))::INT
  + (coalesce(rsi_signal <> 'overbought', true))::INT + (coalesce(entry_signal = 'buy', false))::INT)"""
_GRADES = f"""
scored AS (
  SELECT *, {_points('cagr', fixed.CAGR_POINTS)} + {_points('sharpe_ratio', fixed.SHARPE_POINTS)}
    + {_points('win_rate_pct', fixed.WIN_RATE_POINTS)}
    + CASE WHEN {_SIGNALS} >= 3 THEN 25 WHEN {_SIGNALS} >= 2 THEN 15 WHEN {_SIGNALS} >= 1 THEN 5 ELSE 0 END AS score
  FROM bundle
),
graded AS (
  SELECT *, {when([(f'score >= {a}', quoted(g)) for a, g in fixed.GRADE_LETTERS], "'F'")} AS grade,
    CASE WHEN score >= 70 THEN 'BUY' WHEN score >= 50 THEN 'HOLD' ELSE 'AVOID' END AS investment_recommendation,
    CASE WHEN cagr > 15 AND sharpe_ratio > 1.0 AND max_drawdown_pct > -20 THEN 'BUY'
      WHEN cagr > 8 AND sharpe_ratio > 0.5 THEN 'HOLD' ELSE 'SELL' END AS rule_recommendation,
    CASE WHEN max_drawdown_pct < -25 THEN 'HIGH' WHEN max_drawdown_pct < -15 THEN 'MEDIUM' ELSE 'LOW' END AS rule_risk_level
  FROM scored
)"""


@query("investment_grade", with_(*_BUNDLE, _GRADES) + f"""
SELECT product_id, score, grade, investment_recommendation,
  {when([(f"cagr > {a}", quoted(w)) for a, _, w in fixed.CAGR_POINTS], "'Negative'")} AS growth_word,
  CASE WHEN {_SIGNALS} >= 3 THEN 'Strong technical indicators' WHEN {_SIGNALS} >= 2 THEN 'Mixed technical indicators'
    WHEN {_SIGNALS} >= 1 THEN 'Weak technical indicators' ELSE 'Bearish technical indicators' END AS technical_reason
FROM graded""")
def investment_grade(spark, sf_dir):
    rows = decide.investment_grade(metrics.metric_bundle(daily_series(spark, sf_dir)))
    return rows.select(
        "product_id", "score", "grade", "investment_recommendation",
        F.split(F.col("reasoning")[0], " ")[0].alias("growth_word"),
        F.col("reasoning")[3].alias("technical_reason"),
    )


@query("rule_assessment", with_(*_BUNDLE, _GRADES) + """
SELECT product_id, rule_recommendation, rule_risk_level,
  CASE rule_recommendation WHEN 'BUY' THEN 'Strong performance with acceptable risk'
    WHEN 'HOLD' THEN 'Moderate performance with balanced risk' ELSE 'Poor risk-adjusted returns' END AS overall_assessment
FROM graded""")
def rule_assessment(spark, sf_dir):
    rows = decide.rule_assessment(metrics.metric_bundle(daily_series(spark, sf_dir)))
    return rows.select("product_id", "rule_recommendation", "rule_risk_level", "overall_assessment")


_SCORE_A = when([(f"investment_recommendation = '{v}'", str(s)) for v, s in fixed.VERDICT_SCORES.items()], "3")
_SCORE_B = when([(f"rule_recommendation = '{v}'", str(s)) for v, s in fixed.VERDICT_SCORES.items()], "3")
_MEAN = f"(({_SCORE_A}) + ({_SCORE_B})) / 2"


@query("combined_recommendation", with_(*_BUNDLE, _GRADES) + f"""
SELECT product_id, CASE WHEN {_MEAN} >= 4.5 THEN 'STRONG_BUY' WHEN {_MEAN} >= 3.5 THEN 'BUY' WHEN {_MEAN} >= 2.5 THEN 'HOLD'
  WHEN {_MEAN} >= 1.5 THEN 'SELL' ELSE 'STRONG_SELL' END AS recommendation,
  {hu('(score / 100.0 + 0.8) / 2', 2)} AS confidence, grade
FROM graded""")
def combined_recommendation(spark, sf_dir):
    bundle = decide.rule_assessment(metrics.metric_bundle(daily_series(spark, sf_dir)))
    rows = decide.graded_recommendation(decide.investment_grade(bundle), "rule_recommendation")
    return rows.select("product_id", "recommendation", "confidence", "grade")


@query("analysis_records", with_(*_BUNDLE, _GRADES) + f"""
SELECT product_id, {stamp(f"TIMESTAMP '{AS_OF}'")} AS analysis_date, '2.0' AS analysis_version,
  investment_recommendation AS recommendation, {hu('score / 100.0', 2)} AS confidence_score,
  {day('start_date')} AS data_range_start, {day('end_date')} AS data_range_end, total_points AS total_data_points,
  cagr, sharpe_ratio, max_drawdown_pct AS max_drawdown, grade AS investment_grade
FROM graded""")
def analysis_records(spark, sf_dir):
    rows = analysis.analyze(daily_series(spark, sf_dir), as_of())
    return days_as_text(rows.select("*", "performance_summary.*").drop("performance_summary", "metrics"))


_BASIC = f"""
thirds AS (
  SELECT product_id, count(*) AS sample_size, min(price_date) AS start_date, max(price_date) AS end_date,
    count(DISTINCT source) AS source_count, {hu('avg(price)', 2)} AS average, min(price) AS minimum, max(price) AS maximum,
    {hu('stddev_pop(price)', 2)} AS volatility, {hu('stddev_pop(price) / avg(price) * 100', 2)} AS volatility_percent,
    {hu('avg(price) / max(price) * 100', 2)} AS current_vs_max, {hu('avg(price) / min(price) * 100', 2)} AS current_vs_min,
    avg(price) FILTER (WHERE ord <= n // 3) AS early, avg(price) FILTER (WHERE back <= n // 3) AS late,
    {SPAN} AS date_range_days,
    ({when([(f'count(*) >= {a}', str(p)) for a, p in fixed.VOLUME_POINTS], '0')}
      + CASE WHEN count(DISTINCT source) >= 2 THEN 30 ELSE 15 END
      + {when([(f'{SPAN} >= {a}', str(p)) for a, p in fixed.SPAN_POINTS], '0')}) / 100 AS quality_score
  FROM points GROUP BY product_id
),
basic AS (
  SELECT * EXCLUDE (early, late),
    CASE WHEN early IS NULL THEN 'stable' WHEN late > early THEN 'rising' ELSE 'falling' END AS trend_direction,
    {hu('coalesce(abs(late - early) / early, 0) * 100', 2)} AS trend_strength
  FROM thirds
)"""


@query("basic_analysis", with_(*BASE, _BASIC) + f"""
SELECT * REPLACE ({day('start_date')} AS start_date, {day('end_date')} AS end_date) FROM basic""")
def basic_analysis(spark, sf_dir):
    return days_as_text(metrics.basic_analysis(daily_series(spark, sf_dir)))


@query("trend_thirds", with_(*BASE, _BASIC) + """
SELECT product_id, sample_size AS chronological_sample, trend_direction, trend_strength FROM basic""")
def trend_thirds(spark, sf_dir):
    return metrics.trend_thirds(daily_series(spark, sf_dir))


_VERDICT = """
verdicts AS (
  SELECT *,
    CASE WHEN quality_score >= 0.8 THEN 1 WHEN quality_score < 0.4 THEN -1 ELSE 0 END
    + CASE WHEN volatility_percent < 15 THEN 2 WHEN volatility_percent > 30 THEN -1 ELSE 0 END
    + CASE WHEN trend_direction = 'rising' AND trend_strength > 5 THEN 2
           WHEN trend_direction = 'falling' AND trend_strength > 10 THEN -2 ELSE 0 END
    + CASE WHEN current_vs_max < 80 THEN 1 WHEN current_vs_max > 95 THEN -1 ELSE 0 END
    + CASE WHEN source_count >= 2 THEN 1 ELSE 0 END AS score,
    quality_score * 0.7 + 0.3 AS base
  FROM basic
)"""


@query("recommendation", with_(*BASE, _BASIC, _VERDICT) + f"""
SELECT product_id, score, CASE WHEN score >= 4 THEN 'BUY' WHEN score <= -2 THEN 'AVOID' ELSE 'HOLD' END AS recommendation,
  {hu('CASE WHEN score >= 4 THEN least(0.9, base + 0.2) WHEN score >= 2 OR score <= -2 THEN least(0.8, base + 0.1) WHEN score >= 0 THEN base ELSE base - 0.1 END', 2)} AS confidence,
  CASE WHEN volatility_percent > 25 THEN 'HIGH' WHEN volatility_percent > 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  {hu('average * (1 - (0.1 + volatility_percent / 100 * 0.1))', 2)} AS buy_below,
  {hu('average * (1 + (0.15 + volatility_percent / 100 * 0.15))', 2)} AS sell_above,
  CASE WHEN quality_score >= 0.8 THEN 1 WHEN quality_score < 0.4 THEN 1 ELSE 0 END
    + CASE WHEN volatility_percent < 15 OR volatility_percent > 30 THEN 1 ELSE 0 END
    + CASE WHEN (trend_direction = 'rising' AND trend_strength > 5) OR (trend_direction = 'falling' AND trend_strength > 10) THEN 1 ELSE 0 END
    + CASE WHEN current_vs_max < 80 OR current_vs_max > 95 THEN 1 ELSE 0 END + 1 AS reason_count
FROM verdicts""")
def recommendation(spark, sf_dir):
    rows = decide.recommendation(metrics.basic_analysis(daily_series(spark, sf_dir)))
    return rows.withColumn("reason_count", F.size("reasoning")).drop("reasoning")


# -- portfolio ---------------------------------------------------------------------------------------

_ALIGNED = """
usable AS (SELECT * FROM points WHERE n > 1),
aligned AS (SELECT product_id, back, returns FROM usable WHERE back <= (SELECT min(n) FROM usable))"""


@query("portfolio_metrics", with_(*BASE, _ALIGNED, f"""
stats AS (SELECT product_id, avg(returns) AS mu, sqrt(count(*) * var_pop(returns)) AS len FROM aligned GROUP BY 1),
z AS (SELECT a.product_id, back, (returns - mu) / nullif(len, 0) AS z FROM aligned a JOIN stats USING (product_id)),
per AS (SELECT back, sum(z) AS s FROM z GROUP BY back),
m AS (SELECT count(DISTINCT product_id) AS m FROM z WHERE z IS NOT NULL),
mean AS (SELECT ((SELECT sum(s * s) FROM per) - m) / 2 / (m * (m - 1) / 2) AS c FROM m),
port AS (SELECT back, avg(returns) AS r FROM aligned GROUP BY back)""") + f"""
SELECT {hu('(SELECT c FROM mean)', 3)} AS avg_correlation, {hu(f'stddev_pop(r) * {ANNUAL} * 100', 2)} AS portfolio_volatility,
  {hu('1 - (SELECT c FROM mean)', 3)} AS diversification_ratio,
  (SELECT count(DISTINCT product_id) FROM aligned) AS products_count, count(*) AS aligned_points
FROM port""")
def portfolio_metrics(spark, sf_dir):
    return portfolio.portfolio_metrics(daily_series(spark, sf_dir))


_SET_SERIES = f"""
series AS (
  SELECT {{set}} AS product_id, CAST(sold_date AS DATE) AS price_date, 'all' AS source, 'all' AS condition_category,
    {hu('median(price)', 2)} AS price
  FROM listings WHERE price > 0 GROUP BY ALL
)"""


def set_series(spark, sf_dir):
    """Daily medians per set: a handful of members, whatever the number of listings."""
    rows = views.listings(spark, sf_dir)
    return daily_median_series(
        rows.withColumns({
            "product_id": views.set_name(F.col("product_id")), "source": F.lit("all"),
            "is_graded": F.lit(False), "condition_category": F.lit("raw"),
        }).drop("product_type")
    )


def _set_sql():
    return _SET_SERIES.format(set=set_name("product_id"))


_PAIRS = """
pairs AS (
  SELECT a.product_id AS name_a, b.product_id AS name_b, corr(a.returns, b.returns) AS c
  FROM aligned a JOIN aligned b ON a.back = b.back AND a.product_id < b.product_id GROUP BY 1, 2
)"""


@query("portfolio_correlation", with_(LISTINGS, _set_sql(), POINTS, _ALIGNED, _PAIRS) + f"""
SELECT name_a, name_b, {hu('c', 4)} AS correlation FROM pairs""")
def portfolio_correlation(spark, sf_dir):
    return portfolio.correlation_pairs(set_series(spark, sf_dir))


@query("portfolio_max_correlation", with_(LISTINGS, _set_sql(), POINTS, _ALIGNED, _PAIRS) + f"""
SELECT max({hu('c', 4)}) AS max_correlation FROM pairs""")
def portfolio_max_correlation(spark, sf_dir):
    return portfolio.max_correlation(portfolio.correlation_pairs(set_series(spark, sf_dir)))


@query("event_returns_summary", with_(EVENT_SERIES, POINTS) + f"""
SELECT product_id, count(*) AS total_periods, {hu('avg(returns)', 4)} AS mean_return,
  {hu('stddev_samp(returns)', 4)} AS std_return, {hu('max(returns)', 4)} AS best, {hu('min(returns)', 4)} AS worst
FROM points WHERE n >= 2 GROUP BY product_id""")
def event_returns_summary(spark, sf_dir):
    rows = metrics.with_returns(event_series(spark, sf_dir)).filter(F.col("n") >= 2)
    r = F.col("returns")
    return rows.groupBy("product_id").agg(
        F.count("*").alias("total_periods"), half_up(F.avg(r), 4).alias("mean_return"),
        half_up(F.stddev_samp(r), 4).alias("std_return"), half_up(F.max(r), 4).alias("best"),
        half_up(F.min(r), 4).alias("worst"),
    )
