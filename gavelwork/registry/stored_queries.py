"""Stored and sketched forms: bucketed series, table functions, partners, target tables, levels, sketches, replayed runs."""

import uuid

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators import ingest, levels, metrics, partners, series, targets
from gavelwork.registry.base import (
    AS_OF, CARDS, EVENT_SERIES, LISTINGS, POINTS, SERIES, as_of, card_name, daily_series, day, days_as_text, hu, listings, query, set_name, stamp, with_,
)
from gavelwork.registry.metric_queries import _BUNDLE
from gavelwork.registry.series_queries import event_series
from gavelwork.session import scratch_path
from gavelwork.sources import starviews as views


def bucketed_series(spark, sf_dir):
    name = f"series_{uuid.uuid4().hex}"
    return series.store_bucketed(daily_series(spark, sf_dir), name, scratch_path(spark, name))


@query("stored_metric_bundle", with_(*_BUNDLE) + f"""
SELECT product_id, total_points, {day('start_date')} AS start_date, {day('end_date')} AS end_date, total_return, cagr,
  annualized_volatility, sharpe_ratio, sortino_ratio, max_drawdown_pct, win_rate_pct, profit_factor, rsi_current, entry_signal
FROM bundle""")
def stored_metric_bundle(spark, sf_dir):
    """The bundle over a bucketed table of series."""
    rows = metrics.metric_bundle(bucketed_series(spark, sf_dir))
    return days_as_text(rows.select(
        "product_id", "total_points", "start_date", "end_date",
        *[f"returns_analysis.{c}" for c in ("total_return", "cagr", "annualized_volatility")],
        *[f"risk_metrics.{c}" for c in ("sharpe_ratio", "sortino_ratio", "max_drawdown_pct")],
        *[f"performance_metrics.{c}" for c in ("win_rate_pct", "profit_factor")],
        "technical_indicators.rsi_current", "market_timing.entry_signal",
    ))


@query("summary_function", with_(LISTINGS, SERIES) + f"""
SELECT k.product_id, count(price) AS points, min(price) AS lowest, {hu('avg(price)', 4)} AS average, max(price) AS highest,
  {day('min(price_date)')} AS first_day, {day('max(price_date)')} AS last_day,
  count(price) FILTER (WHERE price_date >= DATE '1998-01-01') AS recent_points
FROM (SELECT 'card-' || p_partkey AS product_id FROM part UNION ALL SELECT 'sealed-' || p_partkey FROM part) k
LEFT JOIN series USING (product_id) GROUP BY 1""")
def summary_function(spark, sf_dir):
    """Both SQL functions, called for all products of the catalog in one plan."""
    points = scratch_path(spark, "function-series")
    daily_series(spark, sf_dir).write.parquet(points)
    spark.read.parquet(points).createOrReplaceTempView("stored_series")
    series.create_functions(spark, "stored_series")
    views.read(spark, sf_dir, "part").select(F.explode(F.array(
        F.concat(F.lit("card-"), "p_partkey"), F.concat(F.lit("sealed-"), "p_partkey"))).alias("product_id")).createOrReplaceTempView("catalog_keys")
    rows = spark.sql("""
      SELECT k.product_id, s.*, h.recent_points FROM catalog_keys k, LATERAL price_summary(k.product_id) s,
        LATERAL (SELECT count(*) AS recent_points FROM price_history(k.product_id, DATE '1998-01-01')) h""")
    return days_as_text(rows.withColumn("average", half_up(F.col("average"), 4)))


_ALIGNED_SQL = """
usable AS (SELECT * FROM points WHERE n > 1),
aligned AS (SELECT product_id, back, returns FROM usable WHERE back <= (SELECT min(n) FROM usable)),
pairs AS (
  SELECT a.product_id AS member, b.product_id AS partner, corr(a.returns, b.returns) AS c
  FROM aligned a JOIN aligned b ON a.back = b.back AND a.product_id <> b.product_id GROUP BY 1, 2
)"""


@query("closest_partners", with_(EVENT_SERIES, POINTS, _ALIGNED_SQL) + f"""
SELECT CAST(member AS VARCHAR) AS member, row_number() OVER (PARTITION BY member ORDER BY c DESC, CAST(partner AS VARCHAR)) AS position,
  CAST(partner AS VARCHAR) AS partner, {hu('c', 4)} AS correlation
FROM pairs WHERE isfinite(c) QUALIFY position <= 5""")
def closest_partners(spark, sf_dir):
    found = partners.closest_partners(event_series(spark, sf_dir), 5, block=64)
    return found.withColumn("position", F.col("position").cast("bigint"))


# targets are pieces of names and sets of other keys; some are whole, with the number of a card
_WHOLE, _KEY, _SET_KEY = "c_custkey % 5 = 0", "c_custkey", "c_custkey * 8"
_TARGETS_SQL = f"""
targets AS (
  SELECT c_custkey AS target_id, CASE WHEN {_WHOLE} THEN {card_name(_KEY)} ELSE upper(substr({card_name(_KEY)}, 1 + c_custkey % 4, 2 + c_custkey % 7)) END AS target_name,
    CASE WHEN {_WHOLE} THEN {set_name(_KEY)} ELSE lower(substr({set_name(_SET_KEY)}, 1 + c_custkey % 3, 1 + c_custkey % 5)) END AS target_set,
    concat(c_custkey % 200 + 1, '/200') AS target_number
  FROM customer
)"""


def target_table(spark, sf_dir):
    key = F.col("c_custkey")
    whole, name, group = key % 5 == 0, views.card_name(key), views.set_name(key * 8)
    return views.read(spark, sf_dir, "customer").select(
        key.alias("target_id"),
        F.when(whole, name).otherwise(F.upper(F.substring(name, (1 + key % 4).cast("int"), (2 + key % 7).cast("int")))).alias("target_name"),
        F.when(whole, views.set_name(key)).otherwise(F.lower(F.substring(group, (1 + key % 3).cast("int"), (1 + key % 5).cast("int")))).alias("target_set"),
        views.card_number(key).alias("target_number"),
    )


@query("target_match_table", with_(CARDS, _TARGETS_SQL, """
exact AS (SELECT target_id, card_id, c.card_name, c.set_name, c.card_number FROM targets JOIN cards c
  ON c.card_name = target_name AND c.set_name = target_set AND c.card_number = target_number),
near AS (
  SELECT target_id, min_by(c, card_id) AS c FROM targets JOIN cards c ON contains(lower(c.card_name), lower(target_name)) AND contains(lower(c.set_name), lower(target_set))
  WHERE target_id NOT IN (SELECT target_id FROM exact) GROUP BY 1
)""") + """
SELECT *, 'exact' AS match_kind FROM exact
UNION ALL SELECT target_id, c.card_id, c.card_name, c.set_name, c.card_number, 'partial' FROM near""")
def target_match_table(spark, sf_dir):
    return targets.target_match_table(views.cards(spark, sf_dir), target_table(spark, sf_dir))


_LEVEL_SETS = ", ".join("(" + ", ".join(level) + ")" for level in levels.LEVELS)
_LEVEL_NAME = """CASE WHEN grouping(set_name) = 0 THEN 'set_name' WHEN grouping(condition_category) = 0 AND grouping(search_strategy) = 0
    THEN 'condition_category+search_strategy' WHEN grouping(condition_category) = 0 THEN 'condition_category'
    WHEN grouping(search_strategy) = 0 THEN 'search_strategy' ELSE 'total' END"""
_IN_SETS = f"in_sets AS (SELECT *, {set_name('product_id')} AS set_name FROM listings)"


def in_sets(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("set_name", views.set_name(F.col("product_id")))


@query("level_summary", with_(LISTINGS, _IN_SETS) + f"""
SELECT {_LEVEL_NAME} AS level, condition_category, search_strategy, set_name, count(*) AS listings, count(*) FILTER (WHERE price > 0) AS priced,
  {hu('avg(price) FILTER (WHERE price > 0)', 4)} AS avg_price, min(price) FILTER (WHERE price > 0) AS lowest,
  max(price) FILTER (WHERE price > 0) AS highest, count(DISTINCT product_id) AS items
FROM in_sets GROUP BY GROUPING SETS ({_LEVEL_SETS})""")
def level_summary(spark, sf_dir):
    return levels.level_summary(in_sets(spark, sf_dir))


@query("sketched_levels", with_(LISTINGS, _IN_SETS) + f"""
SELECT {_LEVEL_NAME} AS level, condition_category, search_strategy, set_name, count(*) AS listings, true AS within
FROM in_sets GROUP BY GROUPING SETS ({_LEVEL_SETS})""")
def sketched_levels(spark, sf_dir):
    """Numbers of products from sketches, told to be within the stated error of the exact ones."""
    rows, names = in_sets(spark, sf_dir), ["condition_category", "search_strategy", "set_name"]
    exact = levels.level_summary(rows).select("level", *names, "listings", F.col("items").alias("exact"))
    about = levels.level_summary(rows, exact=False).select("level", *[F.col(n).alias(f"_{n}") for n in names], "items")
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    met = exact.join(about, ["level"]).filter(same[0] & same[1] & same[2])
    return met.select("level", *names, "listings", (F.abs(F.col("items") - F.col("exact")) <= levels.COUNT_ERROR * F.col("exact") + 1).alias("within"))


@query("sketched_spans", with_(LISTINGS) + """
SELECT condition_category, count(*) AS n, true AS items_within, true AS ranks_within FROM listings
WHERE price > 0 AND CAST(sold_date AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' GROUP BY 1""")
def sketched_spans(spark, sf_dir):
    """Quantiles and products of a span from stored daily sketches, told to be within the stated errors."""
    rows, path, keys = listings(spark, sf_dir), scratch_path(spark, "sketches"), ["condition_category"]
    levels.day_sketches(rows, keys).write.parquet(path)
    spans = levels.span_summary(spark.read.parquet(path), keys, (0.1, 0.5, 0.9), "1994-01-01", "1997-12-31")
    inside = rows.filter((F.col("price") > 0) & F.to_date("sold_date").between("1994-01-01", "1997-12-31"))
    ranked = inside.join(spans.select(*keys, "quantiles"), keys).groupBy(*keys).agg(
        F.count_distinct("product_id").alias("products"),
        *[F.avg((F.col("price") < F.col("quantiles")[i]).cast("double")).alias(f"below_{i}") for i in range(3)],
        *[F.avg((F.col("price") <= F.col("quantiles")[i]).cast("double")).alias(f"upto_{i}") for i in range(3)],
    )
    close = F.lit(True)
    for i, share in enumerate((0.1, 0.5, 0.9)):
        close = close & (F.col(f"below_{i}") - levels.RANK_ERROR <= share) & (F.col(f"upto_{i}") + levels.RANK_ERROR >= share)
    return spans.join(ranked, keys).select(
        *keys, "n", (F.abs(F.col("items") - F.col("products")) <= levels.COUNT_ERROR * F.col("products") + 1).alias("items_within"), close.alias("ranks_within"))


@query("stored_analyses", with_(LISTINGS, SERIES) + f"""
SELECT run, product_id, count(*) AS records, {stamp(f"TIMESTAMP '{AS_OF}'")} AS analysis_date, count(*) AS total_data_points
FROM (SELECT unnest(['first', 'second']) AS run, product_id FROM series) GROUP BY ALL
HAVING count(*) >= 2""".replace("count(*) AS records", "1::BIGINT AS records"))
def stored_analyses(spark, sf_dir):
    """Analyses of two runs, each run again after it was stored, and one broken off before its commit."""
    from gavelwork.operators import versioned
    from gavelwork.plans import analysis

    points, path = scratch_path(spark, "analysed-series"), scratch_path(spark, "analyses")
    daily_series(spark, sf_dir).write.parquet(points)
    records = analysis.analyze(spark.read.parquet(points), as_of()).select("product_id", "analysis_date", "total_data_points")
    for run in ("first", "first", "second", "second"):
        ingest.store_analyses(path, records.withColumn("run", F.lit(run)), run, 0)
    records.limit(10).withColumn("run", F.lit("broken")).write.parquet(f"{path}/version=v{9:012d}-broken")
    stored = versioned.read(spark, versioned.table(spark, path))
    return days_as_text(stored.groupBy("run", "product_id", "analysis_date", "total_data_points").agg(F.count("*").alias("records")))
