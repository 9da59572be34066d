import numpy as np
import pytest

from gavelwork.llm import vectors
from tests.llm.helpers import components

NAN, INF = float("nan"), float("inf")


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return a @ b / np.sqrt((a @ a) * (b @ b))


def near(rng, base, spread):
    return (base + spread * rng.normal(size=base.shape)).astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, dims = [], 24
    for _ in range(12):
        base = rng.normal(size=dims)
        out += [near(rng, base, 0.16 + 0.02 * k).tolist() for k in range(9)]
    out += [out[0]] * 5 + [(3 * np.array(out[1])).tolist()]
    bad = [None, [0.0] * dims, [None] + [1.0] * (dims - 1), [NAN] * dims, [INF] + [0.0] * (dims - 1), [], [1.0, 2.0], [2.0, 4.0]]
    return [(i, v, "x") for i, v in enumerate(out + bad)] + [(None, out[0], "x"), (None, None, "x")]


@pytest.mark.parametrize("block", [17, 8192])
def test_links_and_components(spark, rows, block):
    fine = {i: v for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}

    def linked(a, b):
        return len(fine[a]) == len(fine[b]) and cosine(fine[a], fine[b]) >= 0.95

    label = components(list(fine), linked)
    counts = {i: sum(linked(i, j) for j in fine if j != i) for i in fine}
    assert 0 < sum(counts.values())
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = vectors.near_vectors(frame, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        want = (0, i, True) if i not in fine else (counts[i], label[i], label[i] == i)
        assert (r["n_links"], r["component_id"], r["kept"]) == want, r
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(nothing).count() == 0


def test_bound_drops_no_pair():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 40))
    x = vectors._unit(np.concatenate([base + s * rng.normal(size=base.shape) for s in (0, 0.1, 0.2, 0.3)]))
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    r = x @ rotation
    i, j, value = vectors.tile_pairs(r, r, vectors.suffix_norms(r), vectors.suffix_norms(r), 0.9)
    got = {(a, b) for a, b, v in zip(i, j, value, strict=True) if v >= 0.9}
    assert got == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True)}


def test_hook_spans_components():
    rng = np.random.default_rng(6)
    i, j = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    label = np.arange(300)
    a, b = vectors.hook(label, i, j)
    want = components(range(300), lambda p, q: (p, q) in pairs) if (pairs := set(zip(i.tolist(), j.tolist(), strict=True)) | set(zip(j.tolist(), i.tolist(), strict=True))) else {}
    assert label.tolist() == [want[k] for k in range(300)]
    assert len(a) == len(b) == 300 - len(set(label.tolist()))
