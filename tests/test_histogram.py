import random
import statistics

import pytest
from pyspark.sql import functions as F

from gavelwork.operators import histogram
from gavelwork.operators.histogram import exclusive_quartiles, histogram_medians, price_histogram, weighted_percentile


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(7)
    made = {f"g{n}": [round(rng.uniform(1, 20), 2) for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 10, 40, 101)}
    made["flat"] = [5.0] * 9
    made["ties"] = [1.0, 1.0, 2.0, 2.0, 2.0, 9.0]
    return made


@pytest.fixture(scope="module")
def frame(spark, groups):
    return spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "g string, price double")


def test_exclusive_quartiles(frame, groups):
    for row in exclusive_quartiles(price_histogram(frame, ["g"]), ["g"]).collect():
        prices = groups[row.g]
        assert row.n_total == len(prices)
        if len(prices) < 2:
            assert row.q1 is None
            continue
        q1, _, q3 = statistics.quantiles(prices, n=4)
        assert row.q1 == pytest.approx(q1)
        assert row.q3 == pytest.approx(q3)


def test_medians(frame, groups):
    for row in histogram_medians(price_histogram(frame, ["g"]), ["g"]).collect():
        assert row.median == pytest.approx(statistics.median(groups[row.g]))
        assert row.n_total == len(groups[row.g])


def test_weighted_percentile(frame, groups):
    rows = price_histogram(frame, ["g"]).groupBy("g").agg(
        weighted_percentile(F.col("price"), 0.25, F.col("n_rows")).alias("p")
    ).collect()
    for row in rows:
        prices = groups[row.g]
        expected = prices[0] if len(prices) == 1 else statistics.quantiles(prices, n=4, method="inclusive")[0]
        assert row.p == pytest.approx(expected)


def test_one_group_with_most_rows(spark):
    """A group of 200,000 rows and 50 prices reaches its task as 50 rows."""
    hot = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") % 50).cast("double").alias("price"))
    counts = price_histogram(hot, ["g"])
    assert counts.count() == 50
    row = histogram_medians(counts, ["g"]).first()
    assert (row.median, row.n_total) == (24.5, 200_000)


def test_medians_hold_no_row_for_each_group(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), (None, 2.0), ("b", 4.0), ("b", 5.0)], "k string, price double")
    medians = histogram.histogram_medians(histogram.price_histogram(rows, ["k"]), ["k"])
    plan = medians._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Window")[0]
    assert {(r.k, r.median, r.n_total) for r in medians.collect()} == {("a", 3.0, 3), (None, 2.0, 1), ("b", 4.5, 2)}
