"""End-to-end paths, sinks and seeds, and numbers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.operators import audits, catalog, ingest, metrics, quality
from gavelwork.plans import analysis
from gavelwork.rules import fixed
from gavelwork.session import shared_dir

DAY = dt.date(2024, 1, 1)


def listings(spark, rows):
    """(product_type, product_id, condition, price, day of the year)"""
    schema = "product_type string, product_id int, condition_category string, price double, day int"
    return spark.createDataFrame(rows, schema).selectExpr(
        "concat_ws('-', product_type, product_id, monotonically_increasing_id()) listing_id", "product_type", "product_id",
        "'Charizard V' product_name", "'Charizard V Pokemon card' title", "'pricecharting' source", "false is_graded",
        "condition_category", "price", "timestamp '2024-01-01' + make_dt_interval(day) sold_date")


def points(spark, prices, product="card-1"):
    rows = [(product, DAY + dt.timedelta(days=i), "a", "raw", float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "product_id string, price_date date, source string, condition_category string, price double")


def test_null_is_a_group_of_its_own(spark):
    """Ten listings without a condition at 10 to 12 and one at 900: the limits of the NULL group apply."""
    rows = listings(spark, [("card", 1, None, 10.0 + i % 3, i) for i in range(10)] + [("card", 1, None, 900.0, 3)])
    judged = quality.filter_listings(rows).collect()
    assert [r.price for r in judged if r.removed_by] == [900.0]
    assert quality.clean_listings(rows).count() == 10
    counts = quality.filter_counts(rows)
    assert counts.filter("removed_by is not null").agg(F.sum("n_rows")).first()[0] == 1
    assert analysis.aggregate_listings(rows).agg(F.sum("listing_count")).first()[0] == 10


def test_card_outliers_of_null_products_and_audit_of_null_sources(spark):
    rows = listings(spark, [(None, 1, "raw", 10.0 + i % 3, i) for i in range(10)] + [(None, 1, "raw", 900.0, 3)]).withColumn("condition", F.lit(None).cast("string"))
    assert [r.price for r in quality.card_outliers(rows).collect()] == [900.0]
    series = points(spark, [10, 11, 12, 10, 11, 900]).withColumn("source", F.lit(None).cast("string"))
    row = audits.series_outlier_audit(series).first()
    assert row["points"] == 6 and row["outliers"] == 1


def test_clean_series_reads_the_listings_once(spark, tmp_path):
    path = str(tmp_path / "listings")
    listings(spark, [("card", 1, "raw", 10.0 + i, i) for i in range(6)]).write.parquet(path)
    plan = analysis.aggregate_listings(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_run_stores_series_and_analyses(spark, tmp_path):
    series, analyses = str(tmp_path / "series"), str(tmp_path / "analyses")
    rows = listings(spark, [(t, 1, "raw", p + i, i) for t, p in (("card", 10.0), ("sealed", 100.0)) for i in range(12)])
    now = F.lit("2024-03-01").cast("timestamp")
    analysis.run(rows, series, analyses, now)
    analysis.run(rows, series, analyses, now)
    assert {r.product_id for r in ingest.read_merged(spark, series).collect()} == {"card-1", "sealed-1"}
    assert ingest.read_merged(spark, series).count() == 24
    assert sorted(r.product_id for r in spark.read.parquet(analyses).collect()) == ["card-1", "card-1", "sealed-1", "sealed-1"]


def test_filtered_series_and_simple_analysis(spark):
    series = points(spark, [10, 11, 12, 10, 11, 12, 900])
    assert analysis.filtered_series(series).count() == 6
    row = analysis.analyze_simple(analysis.filtered_series(series)).first()
    assert row["product_id"] == "card-1" and row["recommendation"] and row["reasoning"]


def test_drawdown_by_hand(spark):
    """100 to 120, down to 90 (a quarter off the peak) two days later, back at 120 three days after that."""
    row = metrics.drawdown(metrics.with_returns(points(spark, [100, 120, 100, 90, 100, 110, 120]))).first()
    assert row["max_drawdown_pct"] == -25.0
    assert (row["max_drawdown_duration_days"], row["recovery_to_peak_days"]) == (2, 3)
    ratios = metrics.performance(metrics.with_returns(points(spark, [100, 110, 99]))).first()
    # returns 0, +10 %, -10 %: one of three wins, gains and losses are equal
    assert (ratios["win_rate_pct"], ratios["avg_win_pct"], ratios["avg_loss_pct"], ratios["profit_factor"]) == (33.33, 10.0, -10.0, 1.0)


def test_sinks_can_be_read_back(spark, tmp_path):
    rows = points(spark, [1, 2, 3])
    ingest.write_json(rows, str(tmp_path / "json"))
    ingest.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "json")).orderBy("price").collect() == rows.orderBy("price").collect()
    assert spark.read.schema(rows.schema).option("header", True).csv(str(tmp_path / "csv")).orderBy("price").collect() == rows.orderBy("price").collect()


@pytest.mark.parametrize("seed", [catalog.seed_products, catalog.seed_investments])
def test_seeds_are_inserted_once(spark, seed):
    rows = seed(spark)
    key = rows.columns[:1]
    first = ingest.insert_missing(rows.limit(0), rows, key)
    assert first.count() == rows.select(*key).distinct().count() > 0
    assert ingest.insert_missing(rows, rows, key).count() == 0


def test_series_alias(spark):
    known = next(iter(fixed.SERIES_ALIASES.items()))
    row = spark.range(1).select(text.series_alias(F.lit(known[0])), text.series_alias(F.lit("no such series"))).first()
    assert tuple(row) == (known[1], None)


def test_shared_folder_stays_the_same(spark):
    assert shared_dir(spark) == shared_dir(spark)
