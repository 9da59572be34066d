"""Centroid clustering against plain Python numbers."""

import hashlib
import math

import numpy as np
import pytest

import __spark_entry__ as contract
from gavelwork.llm import centroids
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")


def expected(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) in exact numbers."""
    kept = [(i, [math.floor(64 * x) if abs(x) < 2 ** 53 else 64 * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centers = [v for _, v in first[:k]]

    def near(v):
        found = [(sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)]
        return min(found)

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centers)]
    best = [(i, *near(v)) for i, v in kept]
    total = {}
    for _, d, j in best:
        total[j] = total.get(j, 0) + d
    return sorted(((i, j, d, total[j], sum(total.values()), ",".join(map(str, centers[j]))) for i, d, j in best), key=str)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_is_the_clustering_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    frame = contract.queries()["op12_centroids"](spark, SF)
    want = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest()) for r in expected(rows)]
    assert collected(frame) == sorted(want, key=str)
    assert [k for _, k in frame.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


def test_hard_rows(spark):
    rng = np.random.default_rng(2)
    own = [rng.normal(size=64).tolist() for _ in range(30)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [NAN] + [1.0] * 63, [INF] * 64, [None] + [1.0] * 63]
    rows = list(enumerate(own + [own[0]] * 9 + [[0.0] * 64, [-0.01] * 64, [1e5] * 64] + bad)) + [(None, own[1]), (None, None), (3, own[2]), (3, own[2])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, narrow string, cluster int").repartition(5)
    assert collected(centroids.clustered(frame)) == expected(rows)
    few = [r for r in rows if r[0] in (1, 2)]
    assert collected(centroids.clustered(frame.filter("vec_id in (1, 2)"))) == expected(few)
    assert centroids.clustered(frame.limit(0)).count() == 0


def test_numbers_beyond_64_bits_stay_exact(spark):
    rows = [(i, [float(2 ** (i % 40)) * (1 - 2 * (i % 2))] * 64) for i in range(80)] + [(100, [1e300] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = collected(centroids.clustered(frame)), expected(rows)
    assert [(r[0], r[1], r[5]) for r in got] == [(r[0], r[1], r[5]) for r in want]
    limit = 2 ** 63
    assert [r[2] for r in got] == [r[2] if r[2] < limit else None for r in want]
    assert [r[3] for r in got] == [r[3] if r[3] < limit else None for r in want]


def test_transform_is_exact_and_undone():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (20, 64))
    z = centroids.walsh(x)
    assert (centroids.unwalsh(z) == x).all()
    assert ((z * z).sum(axis=1) == 64 * (x * x).sum(axis=1)).all()
    signs = centroids.walsh(np.eye(64, dtype=np.int64))
    changes = (np.diff(signs, axis=0) != 0).sum(axis=0)
    assert changes.tolist() == sorted(changes.tolist()) and changes[0] == 0 and set(np.abs(signs).ravel()) == {1}


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_is_that_of_all_distances(kind):
    rng = np.random.default_rng(3)
    x, c = rng.integers(-30, 30, (500, 64)), rng.integers(-30, 30, (16, 64))
    c[7] = c[3]  # ties
    x[:50] = c[7] + rng.integers(-2, 2, (50, 64))
    whole = ((x[:, None] - c) ** 2).sum(axis=2)
    cluster, distance = centroids.nearest(centroids.walsh(x).astype(kind), centroids.walsh(c).astype(kind))
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert 7 not in cluster
