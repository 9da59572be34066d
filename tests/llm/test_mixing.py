import itertools
import random
import re

import numpy as np
import pytest

from gavelwork.llm import mixing
from tests.llm.helpers import ROWS, empty, hard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, share=1.5, repeat=2.0):
    """Targets by resharing the excess until no source is above its most."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, total = budget - sum(fixed.values()), sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if target[s] > repeat * sizes[s]]
        if not above:
            return {**fixed, **target}
        fixed.update({s: repeat * sizes[s] for s in above})


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}{chr(0x1F600 + i)}é"[: rng.randint(2, 4)] + str(i): rng.choice([0, 1, 10, 1000, rng.randint(1, 90000)]) for i in range(rng.randint(1, 12))}
    sizes[None] = 77
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = shared(sizes)
    for row in mixing.targets(rows).collect():
        assert row["target"] == pytest.approx(want[row["source"]]), (row, want)


@pytest.mark.parametrize("seed", range(30))
def test_subset_is_the_nearest_possible(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(0, 60), rng.randint(1, 5))))
    counts = np.array([rng.randint(1, 3) for _ in lengths])
    budget = rng.randint(0, int((lengths * counts).sum()) + 5)
    taken = mixing.subset_counts(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    got = int((lengths * taken).sum())
    every = {sum(n * c for n, c in zip(lengths.tolist(), c, strict=True)) for c in itertools.product(*[range(c + 1) for c in counts])}
    # an even part is taken first, so the very nearest sum may be missed; never by more than a document
    assert abs(got - budget) <= min(abs(s - budget) for s in every) + lengths.max()
    if len(lengths) >= 3 and counts.sum() > 8 and 1 in lengths.tolist():
        assert abs(got - budget) <= 2


def test_many_lengths_meet_the_budget():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 30, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (1, 17, total // 3, total - 5, total, total + 9):
        taken = mixing.subset_counts(lengths, counts, budget)
        assert abs(int((lengths * taken).sum()) - min(budget, total)) <= 5 and (taken <= counts).all()
    huge = np.array([3, 50_000_000])
    taken = mixing.subset_counts(huge, np.array([4, 3]), 100_000_009)
    assert int((huge * taken).sum()) == 100_000_009 and len(taken) == 2


@pytest.mark.parametrize("lengths,counts,budget,words", [
    ([600_000], [1], 450_000, 600_000), ([600_000], [1], 250_000, 0), ([600_000], [1], 550_000, 600_000), ([10, 600_000], [5, 1], 450_000, 600_030),
    ([10, 600_000], [5, 1], 40, 40), ([600_000, 900_000], [1, 1], 500_000, 600_000), ([200_000, 600_000], [1, 1], 450_000, 600_000),
])
def test_a_huge_document_is_taken_where_it_is_nearer(lengths, counts, budget, words):
    lengths = np.array(lengths)
    assert int((lengths * mixing.subset_counts(lengths, np.array(counts), budget)).sum()) == words


def test_mix(spark):
    docs = hard(spark)
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == len(ROWS)
    sizes, of = {}, {}
    for _, text, _, source, _ in ROWS:
        of.setdefault(source, []).append(len(WORD.findall(text or "")))
    sizes = {s: sum(v) for s, v in of.items()}
    want = shared(sizes)
    assert sorted(plan["source_size"]) == sorted(sizes[r[3]] for r in ROWS)
    assert sorted(plan["target"].round(6)) == sorted(round(want[r[3]], 6) for r in ROWS)
    assert plan["times"].between(0, 2).all()
    again = mixing.mix_plan(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "target", "times"]
    assert sorted(map(repr, plan[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.count() == plan["times"].sum()
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_one_length_fills_its_source(spark):
    """A hot source whose documents are all of one length is filled to within half a document."""
    rows = [(i, "one two three", "hot") for i in range(3000)] + [(9000 + i, "a b c d e f g", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).toPandas()
    for _, mine in plan.groupby("source_size"):
        assert abs((mine["times"] * mine["size"]).sum() - mine["target"].iloc[0]) <= mine["size"].iloc[0] / 2 + 1
