"""Bucketed series, table functions, partners, target tables, levels and sketches on small tables."""

import datetime as dt
import itertools
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelwork.operators import catalog, levels, metrics, partners, series, targets
from gavelwork.sources import catalog_files, pages

SERIES = "product_id string, price_date date, source string, condition_category string, price double"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(f"card-{p}", day(i), "a", "raw", float(10 + p % 3 + rng.random())) for p in range(40) for i in range(30)]
    return spark.createDataFrame(rows, SERIES)


def test_bundle_of_bucketed_series_moves_nothing(spark, points, tmp_path):
    name = f"bucketed_{uuid.uuid4().hex}"
    stored = series.store_bucketed(points, name, str(tmp_path / "s"), buckets=4)
    bundle = metrics.metric_bundle(stored)
    assert "Exchange" not in plan_of(bundle) and "Exchange" in plan_of(metrics.metric_bundle(points))
    plain = {r.product_id: r for r in metrics.metric_bundle(points).collect()}
    assert {r.product_id: r for r in bundle.collect()} == plain and len(plain) == 40
    assert len(list((tmp_path / "s").glob("part-*.parquet"))) == 4
    spark.sql(f"DROP TABLE {name}")


def test_functions_in_sql(spark, points):
    points.createOrReplaceTempView("test_series")
    series.create_functions(spark, "test_series")
    rows = spark.sql("SELECT * FROM VALUES ('card-1'), ('card-2'), ('nobody') k(key), LATERAL price_summary(key)").collect()
    own = {p: [r.price for r in points.filter(F.col("product_id") == p).collect()] for p in ("card-1", "card-2")}
    got = {r.key: (r.points, r.lowest, r.highest, r.first_day) for r in rows}
    assert got == {p: (30, min(v), max(v), day(0)) for p, v in own.items()} | {"nobody": (0, None, None, None)}
    late = spark.sql("SELECT * FROM price_history('card-1', DATE '2024-01-29')").collect()
    assert sorted(r.price_date for r in late) == [day(28), day(29)]
    plan = plan_of(spark.sql("SELECT * FROM (SELECT DISTINCT product_id FROM test_series) k, LATERAL price_summary(product_id)"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block", [7, 1024])
def test_partners_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    factors = rng.normal(size=(3, 24))
    rows, k = [], 4
    for p in range(60):
        moves = factors[p % 3] * (p % 5) + rng.normal(size=24)
        if p in (10, 20, 30):
            moves = np.arange(24.0)  # equal series: ties go by name
        if p == 40:
            moves = np.zeros(24)
        price = 50 * np.exp(np.cumsum(0.01 * moves))
        rows += [(f"p{p:02d}", day(i), "a", "raw", float(v)) for i, v in enumerate(price)]
    frame = spark.createDataFrame([*rows, ("lone", day(0), "a", "raw", 1.0)], SERIES)
    got = partners.closest_partners(frame, k, block=block).collect()
    aligned = {}
    for r in metrics.with_returns(frame).filter("n > 1").collect():
        aligned.setdefault(r["product_id"], {})[r["back"]] = r["returns"]
    names = sorted(n for n in aligned if np.ptp(list(aligned[n].values())) > 0)
    x = np.array([[aligned[n][b] for b in range(1, 25)] for n in names])
    whole = np.corrcoef(x)
    for i, name in enumerate(names):
        mine = sorted((r.position, r.partner, r.correlation) for r in got if r.member == name)
        others = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(whole[i, j], 9), names[j]))[:k]
        assert [m[1] for m in mine] == [names[j] for j in others]
        assert [m[2] for m in mine] == pytest.approx([whole[i, j] for j in others], abs=1e-4)
    assert {r.member for r in got} == set(names) and len(got) == k * len(names)
    assert partners.closest_partners(frame.limit(0)).count() == 0


def test_exact_targets_are_joined_once_and_by_many_tasks(spark):
    cards = spark.createDataFrame([(i, "Mew", "Base", "1/9") for i in range(60)], "card_id long, card_name string, set_name string, card_number string")
    wanted = spark.createDataFrame([(i, "Mew", "Base", "1/9" if i < 49 else "2/9") for i in range(50)],
                                   "target_id long, target_name string, target_set string, target_number string")
    found = targets.target_match_table(cards.coalesce(1), wanted.coalesce(1))
    assert {r.match_kind: r["count"] for r in found.groupBy("match_kind").count().collect()} == {"exact": 49 * 60, "partial": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "card_number" in line for line in plan.splitlines()) == 1, plan
    assert plan.count("Repartition 4, true") >= 2, plan


def test_block_bounds_lose_no_pair(spark):
    """Two far groups: their blocks are not compared, and nothing changes."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=6) + 0.02 * rng.normal(size=(20, 6)) for _ in range(2)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    about = []
    for own in range(2):
        part = x[20 * own:20 * own + 20]
        products = part @ part.T - 2 * np.eye(20)
        about.append((own, part.mean(axis=0).tolist(), float(np.linalg.norm(part - part.mean(axis=0), axis=1).max()), float(np.sort(products)[:, -3].min())))
    frame = spark.createDataFrame(about, "own int, center array<double>, radius double, floor double")
    across = (x[:20] @ x[20:].T).max()
    assert across < min(a[3] for a in about)
    assert partners.open_pairs(frame, 2).count() == 0
    assert partners.open_pairs(frame.withColumn("floor", F.lit(float(across))), 2).count() == 1


CARDS = [
    (1, "Charizard V", "Base Set", "1/10"), (2, "Charizard VMAX", "Base Set", "1/10"), (3, "Pikachu ex", "Lost Origin", "2/10"),
    (4, "Charizard V", "Base Set", "1/10"), (5, "Pikachu V", "Lost Origin", "3/10"), (6, None, "Base Set", "4/10"), (7, "Mew", None, "5/10"),
    (8, "100% Mew_two", "Odd.Set (1)", "6/10"), (9, "éclair", "Base Set", "7/10"),
]
TARGETS = [
    (1, "Charizard V", "Base Set", "1/10"), (2, "charizard", "base", "9/10"), (3, "PIKACHU", "origin", ""), (4, "u", "o", ""), (5, "Pikachu V", "lost", None),
    (6, "nothing", "base", ""), (7, None, "base", ""), (8, "mew", None, ""), (9, "0% mew_", "odd.set (", ""), (10, "", "lost", ""), (11, "", "", ""),
    (12, "clair", "base set", "x"), (13, "charizard vmaxx", "base set", ""), (3, "PIKACHU", "origin", ""),
]


@pytest.mark.parametrize("gram", [1, 3, 5])
def test_targets_as_a_table(spark, gram):
    cards = spark.createDataFrame(CARDS, "card_id int, card_name string, set_name string, card_number string")
    wanted = spark.createDataFrame(TARGETS, "target_id int, target_name string, target_set string, target_number string")
    found = targets.target_match_table(cards, wanted, gram)
    want = []
    for t, name, group, number in TARGETS:
        exact = [c for c in CARDS if None not in (name, group, number) and c[1:] == (name, group, number)]
        near = [c for c in CARDS if None not in (name, group, c[1], c[2]) and (name or group) and name.lower() in c[1].lower() and group.lower() in c[2].lower()]
        want += [(t, *c, "exact") for c in exact] or [(t, *c, "partial") for c in near[:1]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert targets.target_match_table(cards.limit(0), wanted).count() == 0 == targets.target_match_table(cards, wanted.limit(0)).count()


def test_table_agrees_with_the_literal_list(spark):
    cards = spark.createDataFrame(CARDS, "card_id int, card_name string, set_name string, card_number string").filter("card_name is not null and set_name is not null")
    literal = [("Charizard V", "Base Set", "1/10"), ("pikachu", "origin", "none"), ("mew", "odd", "x")]
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(literal)], "target_id int, target_name string, target_set string, target_number string")
    one = sorted((r.card_id, r.match_kind) for r in catalog.target_matches(cards, literal).collect())
    assert sorted((r.card_id, r.match_kind) for r in targets.target_match_table(cards, table).collect()) == one


def listed(spark):
    rows = [(i % 37, ["raw", "graded", None][i % 3], ["nm", "psa"][i % 2], f"s{i % 5}", float(i % 11), dt.datetime(2024, 1, 1 + i % 20)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "product_id int, condition_category string, search_strategy string, set_name string, price double, sold_date timestamp")


def test_levels_in_one_aggregation(spark):
    rows, frame = listed(spark)
    got = {(r.level, r.condition_category, r.search_strategy, r.set_name): (r.listings, r["items"]) for r in levels.level_summary(frame).collect()}
    at = {"condition_category": 1, "search_strategy": 2, "set_name": 3}
    want = {}
    for level in levels.LEVELS:
        for values in set(itertools.product(*[{r[at[n]] for r in rows} for n in level])):
            own = [r for r in rows if all(r[at[n]] == v for n, v in zip(level, values, strict=True))]
            named = dict(zip(level, values, strict=True))
            if own:
                key = ("+".join(level) or "total", *[named.get(n) for n in at])
                want[key] = (len(own), len({r[0] for r in own}))
    assert got == want  # a null condition is a group of its own level and not the total
    plan = plan_of(levels.level_summary(frame, exact=False))
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1
    about = {r.level: r["items"] for r in levels.level_summary(frame, [()], exact=False).collect()}
    assert about == {"total": 37}


def test_spans_of_sketches(spark, tmp_path):
    rows, frame = listed(spark)
    path = str(tmp_path / "days")
    levels.day_sketches(frame, ["set_name"]).write.parquet(path)
    spans = levels.span_summary(spark.read.parquet(path), ["set_name"], (0.0, 0.5, 1.0), "2024-01-03", "2024-01-12").collect()
    for r in spans:
        own = sorted(p for _, _, _, s, p, d in rows if s == r.set_name and p > 0 and 3 <= d.day <= 12)
        assert r.n == len(own) and r["quantiles"][0] == own[0] and r["quantiles"][2] == own[-1]
        below, upto = sum(p < r["quantiles"][1] for p in own) / len(own), sum(p <= r["quantiles"][1] for p in own) / len(own)
        assert below - levels.RANK_ERROR <= 0.5 <= upto + levels.RANK_ERROR
        assert r["items"] == len({i for i, _, _, s, p, d in rows if s == r.set_name and p > 0 and 3 <= d.day <= 12})
    assert len(spans) == 5
    wide = spark.range(200_000).selectExpr("id % 50000 product_id", "cast(1 + hash(id) % 1000 as double) + 2000 price", "timestamp '2024-01-01' sold_date", "1 k")
    row = levels.span_summary(levels.day_sketches(wide, ["k"]), ["k"]).first()
    for share, value in zip((0.25, 0.5, 0.75), row["quantiles"], strict=True):
        part = wide.agg(F.avg((F.col("price") < value).cast("double")), F.avg((F.col("price") <= value).cast("double"))).first()
        assert part[0] - levels.RANK_ERROR <= share <= part[1] + levels.RANK_ERROR
    assert abs(row["items"] - 50_000) <= levels.COUNT_ERROR * 50_000


def test_arrays_of_mixed_shape(spark):
    mixed = '<script>chartData = [["2023-01-02", 1, "sale", "$12.50"], {"date": "2023-01-03", "price": 7}, ["bad"], null, {"price": 3}, 5];</script>'
    broken = "<script>chartData = [[1, 2,]; priceData = [{\"date\": \"2023-02-01\", \"price\": \"4.5\"}];</script>"
    plain = "<script>chartData = [1, 2, 3];</script>"
    rows = pages.chart_arrays(spark.createDataFrame([("m", mixed), ("b", broken), ("p", plain), ("n", None)], "url string, html string")).collect()
    assert sorted((r.url, r.date, r.price, r.description) for r in rows if r.url == "m") == [("m", "2023-01-02", 12.5, "sale"), ("m", "2023-01-03", 7.0, None)]
    assert [(r.date, r.price) for r in rows if r.url == "b"] == [("2023-02-01", 4.5)]
    assert {r.url for r in rows} == {"m", "b"}


def test_history_of_mixed_shape(spark, tmp_path):
    lines = [
        {"card_id": "c1", "historical_chart_data": [["2024-01-01", "x", 5], {"date": "2024-01-02", "price": "6.5"}, {"date": "soon", "price": "much"}]},
        {"product_id": "s1", "historical_chart_data": []}, {"card_id": "c2"}, [1, 2],
    ]
    (tmp_path / "h.json").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    got = [tuple(r) for r in catalog_files.mixed_history(spark, str(tmp_path / "h.json")).collect()]
    assert got[:3] == [("c1", day(0), 5.0), ("c1", day(1), 6.5), ("c1", None, None)]
    assert got[3:] == [("s1", None, None), ("c2", None, None), (None, None, None), (None, None, None)]


def test_exact_levels_copy_groups_not_listings(spark):
    rows = [(None, "raw", 1.0), (1, "raw", 2.0), (1, "raw", -2.0), (1, None, 4.0), (2, None, None)]
    frame = spark.createDataFrame(rows, "product_id int, condition_category string, price double")
    summed = levels.level_summary(frame, [("condition_category",), ()])
    got = {(r.level, r.condition_category): (r.listings, r.priced, r.avg_price, r.lowest, r.highest, r["items"]) for r in summed.collect()}
    assert got == {
        ("condition_category", "raw"): (3, 2, 1.5, 1.0, 2.0, 1), ("condition_category", None): (2, 1, 4.0, 4.0, 4.0, 2),
        ("total", None): (5, 3, 2.3333, 1.0, 4.0, 2),
    }
    plan = plan_of(levels.level_summary(frame, [("condition_category",), ()]))
    assert plan.count("Expand") == 1 and "HashAggregate" in plan.split("Expand")[1]
