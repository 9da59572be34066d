"""Whole results of the analyses: every metric of every block, stored metrics read back, and all reason texts."""

from pyspark.sql import functions as F

from gavelwork.operators import decide, metrics
from gavelwork.plans import analysis
from gavelwork.registry.base import SQL, as_of, daily_series, hu, query, quoted, when, with_
from gavelwork.registry.metric_queries import _BASIC, _BUNDLE, _GRADES, _SIGNALS, _VERDICT, BASE
from gavelwork.rules import fixed

BLOCKS = (
    "returns_analysis", "risk_metrics", "performance_metrics", "technical_indicators", "value_at_risk", "statistical_properties",
    "time_series_analysis", "market_timing",
)
_PARTS = (
    "returns_summary", "risk_ratios", "drawdown", "performance", "technical_indicators", "value_at_risk", "return_distribution", "seasonality",
    "market_timing",
)
_WHOLE = "SELECT * FROM " + " LEFT JOIN ".join(f"({SQL[p]}) {p}" + (" USING (product_id)" if i else "") for i, p in enumerate(_PARTS))


def flat(rows):
    """One column for each metric of each block."""
    return rows.select("product_id", *[f"{block}.*" for block in BLOCKS])


@query("whole_bundle", _WHOLE)
def whole_bundle(spark, sf_dir):
    return flat(metrics.metric_bundle(daily_series(spark, sf_dir)))


@query("stored_metrics", _WHOLE)
def stored_metrics(spark, sf_dir):
    """The metrics of analysis records, parsed from their JSON text."""
    points = daily_series(spark, sf_dir)
    kind = metrics.metric_bundle(points).select(*BLOCKS).schema
    records = analysis.analyze(points, as_of())
    return flat(records.select("product_id", F.from_json("metrics", kind).alias("m")).select("product_id", "m.*"))


def fixed_point(value, digits):
    """The number with so many digits, halves away from zero; the sign of what rounds to zero stays."""
    zero = quoted("-" + f"{0:.{digits}f}")
    return f"CASE WHEN {value} < 0 AND {hu(value, digits)} = 0 THEN {zero} ELSE printf('%.{digits}f', {hu(value, digits)}) END"


def _word(value, scale, otherwise):
    return when([(f"{value} > {a}", quoted(w)) for a, _, w in scale], quoted(otherwise))


_GRADE_REASONS = [
    f"{_word('cagr', fixed.CAGR_POINTS, 'Negative')} || ' CAGR of ' || {fixed_point('cagr', 1)} || '%'",
    f"{_word('sharpe_ratio', fixed.SHARPE_POINTS, 'Poor')} || ' Sharpe ratio of ' || {fixed_point('sharpe_ratio', 2)}",
    f"{_word('win_rate_pct', fixed.WIN_RATE_POINTS, 'Low')} || ' win rate of ' || {fixed_point('win_rate_pct', 1)} || '%'",
    f"CASE WHEN {_SIGNALS} >= 3 THEN 'Strong' WHEN {_SIGNALS} >= 2 THEN 'Mixed' WHEN {_SIGNALS} >= 1 THEN 'Weak' ELSE 'Bearish' END || ' technical indicators'",
]


@query("grade_reasons", with_(*_BUNDLE, _GRADES) + f"SELECT product_id, concat_ws(' | ', {', '.join(_GRADE_REASONS)}) AS reasons FROM graded")
def grade_reasons(spark, sf_dir):
    rows = decide.investment_grade(metrics.metric_bundle(daily_series(spark, sf_dir)))
    return rows.select("product_id", F.array_join("reasoning", " | ").alias("reasons"))


_HIGHLIGHTS = [f"'CAGR: ' || {fixed_point('cagr', 1)} || '%'", f"'Sharpe Ratio: ' || {fixed_point('sharpe_ratio', 2)}",
               f"'Max Drawdown: ' || {fixed_point('max_drawdown_pct', 1)} || '%'"]


@query("rule_highlights", with_(*_BUNDLE, _GRADES) + f"SELECT product_id, concat_ws(' | ', {', '.join(_HIGHLIGHTS)}) AS highlights FROM graded")
def rule_highlights(spark, sf_dir):
    rows = decide.rule_assessment(metrics.metric_bundle(daily_series(spark, sf_dir)))
    return rows.select("product_id", F.array_join("key_highlights", " | ").alias("highlights"))


def _if(test, *parts):
    return f"CASE WHEN {test} THEN {' || '.join(parts)} END"


_REASONS = [
    _if("quality_score >= 0.8", "'High-quality data (score: '", fixed_point("quality_score", 2), "') increases confidence'"),
    _if("quality_score < 0.4", "'Limited data quality (score: '", fixed_point("quality_score", 2), "') reduces confidence'"),
    _if("volatility_percent < 15", "'Low volatility ('", fixed_point("volatility_percent", 1), "'%) indicates stable pricing'"),
    _if("volatility_percent > 30", "'High volatility ('", fixed_point("volatility_percent", 1), "'%) indicates risky investment'"),
    _if("trend_direction = 'rising' AND trend_strength > 5", "'Strong upward trend (+'", fixed_point("trend_strength", 1), "'%)'"),
    _if("trend_direction = 'falling' AND trend_strength > 10", "'Downward trend (-'", fixed_point("trend_strength", 1), "'%)'"),
    _if("current_vs_max < 80", "'Currently '", fixed_point("(100 - current_vs_max)", 0), "'% below peak price'"),
    _if("current_vs_max > 95", "'Currently near peak price'"),
    _if("source_count >= 2", "'Data validated across '", "source_count", "' sources'"),
    _if("source_count = 1", "'Single data source - limited validation'"),
]


@query("recommendation_reasons", with_(*BASE, _BASIC, _VERDICT) + f"SELECT product_id, concat_ws(' | ', {', '.join(_REASONS)}) AS reasons FROM verdicts")
def recommendation_reasons(spark, sf_dir):
    rows = decide.recommendation(metrics.basic_analysis(daily_series(spark, sf_dir)))
    return rows.select("product_id", F.array_join("reasoning", " | ").alias("reasons"))
