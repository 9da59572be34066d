"""Merkle manifest against plain Python, its bitmaps against sorted lists."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gavelwork.llm import merkle
from tests.conftest import SF
from tests.llm.helpers import empty, hard
from tests.llm.test_dedup import LOWER

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for name in FIELDS:
        value = row[name]
        if value is None:
            out += "-"
        else:
            value = str(value).translate(LOWER) if lower and name == "text" else str(value)
            out += f"{len(value.encode())}:{value}"
    return h(out)


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, place):
    for level in levels[:-1]:
        begin = place - place % 8
        yield level[begin:place], level[place + 1:begin + 8]
        place //= 8


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for rows_ in groups.values():
        rows_.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: climb([leaf(r) for r in groups[g]]) for g in groups}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for g in order:
        for place, row in enumerate(groups[g]):
            path = [*beside(trees[g], place), *beside(top, order.index(g))]
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None
            fold = leaf(row, lower=tampered)
            for before, after in path:
                fold = h(*before, fold, *after)
            proof = h(*[d for before, after in path for d in before + after])
            out.append((row["doc_id"], leaf(row), trees[g][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=str)


def digests(frame):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(frame, tampered, with_paths=False)


def collected(frame):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_query_is_the_manifest_of_the_table(spark):
    frame = contract.queries()["op11_merkle"](spark, SF)
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert collected(frame) == expected(rows)
    assert [k for _, k in frame.dtypes] == ["bigint", "string", "string", "string", "string", "string", "boolean"]


def test_hard_rows(spark):
    frame = hard(spark)
    assert collected(digests(frame)) == expected(frame.collect())
    assert digests(empty(spark)).count() == 0
    one = frame.filter("doc_id = 1")
    assert collected(digests(one)) == expected(one.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_many_slot_arrays_and_odd_ids(spark, monkeypatch, levels):
    """Small arrays, so that trees need several of them; ids far apart, negative, null and repeated."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SLOTS", merkle.FANOUT ** levels)
    rng = np.random.default_rng(levels)
    ids = [*range(150), *rng.integers(-2 ** 63, 2 ** 63 - 1, 60).tolist(), -2 ** 63, 2 ** 63 - 1, -1, None, None, *[7] * 20, *[-9] * 9]
    langs = [None, "", "a", "A", "é", "zz", *[f"l{i}" for i in range(20)]]
    rows = [(i, f"Text {k % 40}", langs[0 if k % 3 else k % len(langs)], "s", k % 5) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert collected(digests(frame)) == expected(frame.collect())


def test_paths_lead_to_the_root(spark):
    rows = merkle.manifest(hard(spark)).collect()
    for r in rows:
        path = [(p["before"], p["after"]) for p in r["path"]]
        assert merkle.folded(r["leaf"], path) == r["root"] == r["folded_root"] and r["verified"]
        assert h(*[b + a for b, a in path]) == r["proof_sha256"]


@pytest.mark.parametrize("n", [0, 1, 30, 5000, 60000])
def test_rank_of_containers(n):
    rng = np.random.default_rng(n)
    low = np.sort(rng.choice(1 << merkle.LOW_BITS, min(n, 1 << merkle.LOW_BITS), replace=False))
    counts = np.bincount(low, minlength=1)
    counts[low[::7]] += 3
    blob = merkle.container(counts)
    if n:
        before = np.concatenate([[0], np.cumsum(counts)])
        assert (merkle.ranks(blob, low) == before[low]).all()
    again = np.zeros(1 << merkle.LOW_BITS, np.int64)
    merkle.add_counts(blob, again)
    assert (again[:len(counts)] == counts).all() and again.sum() == counts.sum()
    assert len(blob) <= 8 + 8192 + 10 * len(low[::7])
