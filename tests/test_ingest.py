import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelwork.operators import decide, ingest, market, series
from gavelwork.plans import analysis
from gavelwork.session import scratch_path
from gavelwork.streaming import ingest as stream

LISTING = "listing_id string, listing_url string, price double"


def test_first_per_url(spark):
    rows = spark.createDataFrame(
        [("3", "u1", 3.0), ("1", "u1", 1.0), ("2", "u2", 2.0), ("4", "", 4.0), ("5", None, 5.0)], LISTING)
    assert sorted((r.listing_url, r.listing_id) for r in ingest.first_per_url(rows).collect()) == [("u1", "1"), ("u2", "2")]


def test_dedup_limits_rows_before_the_shuffle(spark):
    hot = spark.range(10_000).select(F.col("id").cast("string").alias("listing_id"), F.format_string("u%d", F.col("id") % 1).alias("listing_url"))
    plan = ingest.first_per_url(hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert ingest.first_per_url(hot).count() == 1


def test_new_listings(spark):
    batch = spark.createDataFrame([("1", "u1", 1.0), ("2", "u2", 2.0), ("3", "u2", 2.0)], LISTING)
    stored = spark.createDataFrame([("0", "u1", 1.0)], LISTING)
    assert [r.listing_id for r in ingest.new_listings(batch, stored).collect()] == ["2"]


def test_keyed_merge_and_repeat(spark):
    schema = "product_id int, price_date date, source string, condition_category string, price double"
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([(1, day, "a", "raw", 1.0), (2, day, "a", "raw", 2.0)], schema)
    new = spark.createDataFrame([(2, day, "a", "raw", 9.0), (3, day, "a", "raw", 3.0)], schema)
    path = scratch_path(spark, "merge")
    ingest.store_series(path, old)
    ingest.store_series(path, new)
    ingest.store_series(path, new)
    assert {r.product_id: r.price for r in ingest.read_merged(spark, path).collect()} == {1: 1.0, 2: 9.0, 3: 3.0}


def test_store_cards_keeps_one_row_per_number(spark):
    rows = spark.createDataFrame([("A", "1", "S", "x"), ("B", "1", "S", "x")], "card_name string, card_number string, set_name string, rarity string")
    path = scratch_path(spark, "cards")
    ingest.store_cards(path, rows)
    assert spark.read.parquet(path).count() == 1


def test_prepare_listings(spark):
    raw = spark.createDataFrame([
        (" Charizard ", "u", 5.0, "charizard psa 10", "9.5", "PSA", True, "Sold Jun 2, 2024"),
        ("", "u2", 5.0, "x", "10", "PSA", True, None),
        ("Box", "", 5.0, "x", None, None, False, None),
    ], "title string, listing_url string, price double, search_terms string, grade string, grading_company string, is_graded boolean, sold_text string")
    got = ingest.prepare_listings(raw, F.lit(False), F.lit("2024-07-01").cast("timestamp")).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.title, row.search_strategy, row.condition_category, row.grade_numeric) == ("Charizard", "psa_10", "graded", None)
    assert row.sold_date == dt.datetime(2024, 6, 2)
    sealed = ingest.prepare_listings(raw, F.lit(True), F.lit("2024-07-01").cast("timestamp")).first()
    assert (sealed.search_strategy, sealed.condition_category, sealed.is_graded, sealed.grade) == ("sealed_box", "sealed", False, "")


def test_daily_median(spark):
    rows = spark.createDataFrame([
        ("1", 1, 10.0, "2024-01-01 09:00:00", None, True, None, "a"), ("2", 1, 20.0, "2024-01-01 23:00:00", None, True, None, "b"),
        ("3", 1, 31.01, None, "2024-01-01 05:00:00", True, None, ""), ("4", 1, 0.0, "2024-01-01 05:00:00", None, True, None, "z"),
        ("5", 1, 7.0, None, None, True, None, "z"), ("6", 1, 8.0, "2024-01-02 05:00:00", None, None, "sealed", "s"),
    ], "listing_id string, product_id int, price double, sold string, made string, is_graded boolean, condition_category string, title string")
    rows = rows.withColumn("sold_date", F.col("sold").cast("timestamp")).withColumn("created_at", F.col("made").cast("timestamp"))
    got = {(str(r.price_date), r.condition_category): r for r in series.daily_median_series(rows, "ebay").collect()}
    assert set(got) == {("2024-01-01", "graded"), ("2024-01-02", "sealed")}
    assert got["2024-01-01", "graded"].price == 20.0
    assert got["2024-01-01", "graded"].listing_count == 3
    assert got["2024-01-01", "graded"].data_confidence == pytest.approx(0.3)
    titles = {str(r.price_date): r.sample_titles for r in series.sample_titles(rows, "ebay").collect()}
    assert titles["2024-01-01"] == ["a", "b"]


def test_analysis_cache(spark):
    stamp = "timestamp '2024-01-02 00:00:00'"
    analyses = spark.sql(f"""
      SELECT * FROM VALUES (1, {stamp} - INTERVAL 1 HOUR, 'BUY', 0.5, '2.0'), (1, {stamp} - INTERVAL 2 HOURS, 'HOLD', 0.5, '2.0'),
        (2, {stamp} - INTERVAL 30 HOURS, 'BUY', 0.5, '2.0'), (3, {stamp} - INTERVAL 1 HOUR, 'BUY', 0.5, '1.0')
      AS t(product_id, analysis_date, recommendation, confidence_score, analysis_version)""")
    now = F.expr(stamp)
    assert [(r.product_id, r.recommendation) for r in decide.cached_analyses(analyses, now, 24, "2.0").collect()] == [(1, "BUY")]
    assert decide.cached_analyses(analyses, now, 24).count() == 2
    products = spark.createDataFrame([(1,), (2,), (3,), (4,)], "product_id int")
    used = {r.product_id: r.used_cache for r in decide.split_by_cache(products, decide.cached_analyses(analyses, now, 24, "2.0")).collect()}
    assert used == {1: True, 2: False, 3: False, 4: False}
    points = spark.range(4).selectExpr("1 + id as product_id").crossJoin(spark.range(5).selectExpr("id as d")).selectExpr(
        "cast(product_id as int) product_id", "date_add(date '2024-01-01', cast(d as int)) price_date", "cast(10 + d as double) price",
        "'a' source", "'raw' condition_category")
    done = analysis.analyze_missing(products, points, analyses, now)
    assert sorted(r.product_id for r in done.select("product_id").collect()) == [2, 3, 4]


def test_liquidity_and_premium(spark):
    as_of = F.lit("2024-03-01").cast("timestamp")
    rows = spark.createDataFrame(
        [(1, "raw_nm", 10.0, "2024-02-20")] * 4 + [(1, "psa_10", 30.0, "2024-02-25")] * 2 + [(2, "psa_9", 5.0, "2023-01-01"), (2, "raw_nm", 0.0, None)],
        "product_id int, search_strategy string, price double, sold string",
    ).withColumn("sold_date", F.col("sold").cast("timestamp"))
    got = {r.product_id: r for r in market.market_summary(rows, as_of).collect()}
    assert got[1].grading_premium_psa10 == 200.0 and got[1].market_liquidity == "medium"
    assert got[2].raw_avg_price == 0 and got[2].raw_sold_count == 1 and got[2].grading_premium_psa9 == 0
    assert got[2].total_listings == 2 and got[2].lowest_price == 5.0


def test_stream_ingest_is_incremental(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    schema = "listing_id string, listing_url string, price double, created_at timestamp"

    def land(name, rows):
        frame = spark.createDataFrame([(i, u, p, dt.datetime(2024, 1, d)) for i, u, p, d in rows], schema)
        frame.coalesce(1).write.parquet(f"{folder}/{name}")

    def run():
        source = spark.readStream.schema(schema).parquet(f"{folder}/*")
        stream.start_ingest(source, table, state).awaitTermination()
        return sorted(r.listing_url for r in spark.read.parquet(table).collect())

    land("a", [("1", "u1", 1.0, 1), ("2", "u1", 1.0, 1), ("3", "u2", 1.0, 2), ("4", "", 1.0, 2)])
    assert run() == ["u1", "u2"]
    land("b", [("5", "u1", 1.0, 20), ("6", "u3", 1.0, 20)])  # u1 is past the horizon, the table still knows it
    assert run() == ["u1", "u2", "u3"]
    land("c", [("7", "u9", 1.0, 3), ("8", "u2", 1.0, 25)])  # unseen, though older than all that is stored
    assert run() == ["u1", "u2", "u3", "u9"]
    assert run() == ["u1", "u2", "u3", "u9"]


def test_state_has_as_many_partitions_as_the_rows_need(spark, tmp_path):
    """Not those of the session: each opens a store in every batch, however few rows there are."""
    folder, state = str(tmp_path / "in"), tmp_path / "state"
    spark.createDataFrame([("1", "u1", 1.0), ("2", "u2", 2.0)], LISTING).coalesce(1).write.parquet(folder)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        source = spark.readStream.schema(LISTING).parquet(folder)
        stream.start_ingest(source, str(tmp_path / "table"), str(state)).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (state / "urls" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == spark.sparkContext.defaultParallelism == 4
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_freshness_of_names(spark):
    as_of = F.lit("2024-03-01").cast("timestamp")
    listings = spark.sql("""
      SELECT 'card' product_type, id product_id, timestamp '2024-03-01' - make_dt_interval(age) created_at
      FROM VALUES (1, 3), (1, 40), (2, 10), (3, 60) AS t(id, age)""")
    products = spark.createDataFrame([("card", i, f"p{i}") for i in range(1, 5)], "product_type string, product_id int, product_name string")
    checked = decide.freshness(products.withColumn("set_name", F.lit("s")), listings, as_of, 7)
    found = spark.createDataFrame(
        [("a", "card", 1), ("b", "card", 2), ("c", "card", 3), ("d", "card", 4), ("e", None, None)],
        "query string, product_type string, product_id int")
    got = {r.query: (r.recommended_action, r.days_old) for r in decide.freshness_of_names(found, checked).collect()}
    assert got == {
        "a": ("use_cache", 3), "b": ("scrape_pricecharting_only", 10), "c": ("scrape_both", 60), "d": ("scrape_both", None),
        "e": ("full_setup", None),
    }


def test_card_and_sealed_of_one_number_are_two_products(spark):
    rows = spark.createDataFrame(
        [("card", 1, 10.0, "2024-01-01"), ("sealed", 1, 200.0, "2024-01-01"), ("card", 1, 12.0, "2024-01-01")],
        "product_type string, product_id int, price double, day string",
    ).selectExpr("product_type", "product_id", "price", "to_timestamp(day) sold_date", "'ebay' source", "false is_graded", "'raw' condition_category")
    got = {r.product_id: (r.price, r.listing_count) for r in series.daily_median_series(rows).collect()}
    assert got == {"card-1": (11.0, 2), "sealed-1": (200.0, 1)}


def test_first_of_equal_keys_is_inserted(spark):
    stored = spark.createDataFrame([(1, "a")], "product_id int, product_name string")
    incoming = spark.createDataFrame([(2, "z"), (2, "b"), (1, "x"), (2, None)], "product_id int, product_name string")
    assert [tuple(r) for r in ingest.insert_missing(stored, incoming, ["product_id"]).collect()] == [(2, "b")]


def test_touched_products_alone_are_refreshed_and_stored(spark, tmp_path):
    points = spark.range(1, 4).crossJoin(spark.range(6).selectExpr("id as d")).selectExpr(
        "concat('card-', id) product_id", "date_add(date '2024-01-01', cast(d as int)) price_date", "cast(10 + d as double) price",
        "'a' source", "'raw' condition_category")
    path = str(tmp_path / "analyses")
    now = F.lit("2024-03-01").cast("timestamp")
    ingest.store_analyses(path, analysis.analyze(points, now))
    ingest.store_analyses(path, analysis.analyze(points, now))
    assert spark.read.parquet(path).count() == 6
