"""Closest partners: small blocks and strips against plain NumPy, and how many blocks there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelwork.operators import partners


def test_the_number_of_blocks_stays_bounded():
    assert partners.block_size(1_500, 64) == 64 and partners.block_size(4_096, 64) == 64
    assert all(-(-n // partners.block_size(n, 64)) <= 66 for n in (5_000, 90_000, 540_000))
    assert partners.block_size(10**9, 64) == partners.MOST and partners.block_size(100, 1_024) == 1_024


def test_best_takes_the_first_names_of_ties_and_nothing_below_the_floor():
    rng = np.random.default_rng(2)
    products = rng.integers(0, 6, (40, 30)) / 5
    floor = rng.integers(0, 6, 40) / 5
    members, names = np.array([f"m{i}" for i in range(40)]), np.array([f"p{i:02d}" for i in range(30)])
    got = partners._best(products, members, names, 3, floor)
    want = []
    for i in range(40):
        ranked = sorted((-products[i, j], names[j]) for j in range(30) if products[i, j] >= floor[i])[:3]
        want += [(members[i], name, -value) for value, name in ranked]
    assert list(got.itertuples(index=False, name=None)) == want


@pytest.mark.parametrize(("block", "count"), [(7, 64), (7, 3), (500, 64)])
def test_partners_are_those_of_all_pairs(spark, monkeypatch, block, count):
    monkeypatch.setattr(partners, "COUNT", count)
    rng = np.random.default_rng(4)
    prices = {f"p{i:02d}": rng.integers(1, 9, 6).astype(float) for i in range(30)}
    prices |= {f"q{i}": prices["p03"] for i in range(8)}
    rows = [(name, f"2024-01-0{d + 1}", "s", "m", float(p)) for name, own in prices.items() for d, p in enumerate(own)]
    series = spark.createDataFrame(rows, "product_id string, price_date string, source string, condition_category string, price double").withColumn(
        "price_date", F.to_date("price_date"))
    unit = {r["member"]: np.array(r["v"]) for r in partners.unit_vectors(series).collect()}
    want = {}
    for name, own in unit.items():
        ranked = sorted((-round(float(own @ other), 4), partner) for partner, other in unit.items() if partner != name)
        want[name] = [(i + 1, p, -v) for i, (v, p) in enumerate(ranked[:4])]
    got = {}
    for r in sorted(partners.closest_partners(series, 4, block=block).collect()):
        got.setdefault(r["member"], []).append((r["position"], r["partner"], r["correlation"]))
    assert {n: [c for *_, c in g] for n, g in got.items()} == {n: [c for *_, c in w] for n, w in want.items()}


def test_values_apart_by_rounding_alone_are_ties():
    products = np.array([[1.0 - 2e-16, 1.0, 0.5, 1.0 + 2e-16]])
    got = partners._best(products, np.array(["m"]), np.array(["a", "b", "c", "d"]), 2, np.array([1.0]))
    assert got["partner"].tolist() == ["a", "b"]
