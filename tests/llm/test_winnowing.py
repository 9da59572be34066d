"""Benchmark decontamination against all windows."""

import hashlib
import re

import numpy as np
import pytest

import __spark_entry__ as contract
from gavelwork.llm import winnowing
from tests.conftest import SF
from tests.llm.helpers import empty, hard
from tests.llm.test_dedup import LOWER

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = "item_id long, text string"


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def expected(docs, items, window=10):
    """(doc_id, n_words, hit places, items) by looking at every window."""
    known = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in known:
                    hit.update(range(i, i + n))
                    own |= known[tuple(w[i:i + n])]
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(own))))
    return sorted(out, key=str)


def collected(frame):
    out = []
    for r in frame.collect():
        spans = [(s["begin"], s["end"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and r["n_hit"] == sum(e - b for b, e in spans)
        assert r["n_items"] == len(r["items"]) and r["contaminated"] == bool(spans)
        assert r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        out.append((r["doc_id"], r["n_words"], tuple(i for b, e in spans for i in range(b, e)), tuple(r["items"])))
    return sorted(out, key=str)


def pairs(frame, first):
    return [(r[first], r["text"]) for r in frame.collect()]


def test_query_is_the_scan_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = expected(pairs(docs, "doc_id"), pairs(items, "item_id"))
    frame = contract.queries()["op13_decontamination"](spark, SF)
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert got == sorted(((d, n, len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit)) for d, n, hit, own in want), key=str)
    assert frame.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert [k for _, k in frame.dtypes] == ["bigint", "bigint", "bigint", "bigint", "string", "boolean"]
    assert any(r[5] for r in got)


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (4, 2), (3, 7), (1, 1)])
def test_every_shared_window_is_found(spark, window, gram):
    """Texts of few words, so that marks repeat, windows overlap and items share windows."""
    rng = np.random.default_rng(window)

    def text(n, kinds=5):
        return " ".join("abcdefgh"[i] * int(rng.integers(1, 3)) for i in rng.integers(0, kinds, n))

    items = [(i, text(int(rng.integers(1, 3 * window + 2)))) for i in range(12)] + [(3, text(window + 2)), (None, text(window)), (50, None), (51, " .,;")]
    items += [(60, items[0][1]), (61, items[0][1].upper()), (62, "a a a a a a a a a a a a a a")]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(30)] + [(7, "x"), (None, items[1][1]), (70, None), (71, "")]
    docs += [(80 + i, f"{text(9)} {items[i][1]} zz. {items[i][1]}, {text(3)}") for i in range(10)] + [(95, "A-a " * 500)]
    docs += docs[-3:]
    got = winnowing.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, PLAIN), window, gram)
    assert collected(got) == expected(docs, items, window)


def test_long_items_alone(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, 40))) for i in range(5)]
    docs = [(i, " ".join([*rng.choice(vocabulary, 30), *items[i % 5][1].split()[i:i + 9 + i % 3], *rng.choice(vocabulary, 30)])) for i in range(25)]
    want = expected(docs, items)
    assert collected(winnowing.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, PLAIN))) == want
    assert {bool(hit) for _, _, hit, _ in want} == {True, False}


def test_hard_rows(spark):
    frame = hard(spark)
    items = [(1, "LOREM ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (2, "one two"), (3, "日本"), (4, "s it s"), (5, "5678")]
    table = spark.createDataFrame([(*r, "x") for r in items], f"{PLAIN}, mark string")
    assert collected(winnowing.scan(frame, table)) == expected(pairs(frame, "doc_id"), items)
    assert winnowing.scan(empty(spark), table).count() == 0
    none = winnowing.scan(frame, table.limit(0)).collect()
    assert len(none) == frame.count() and not any(r["contaminated"] for r in none)


def test_main_path_is_native(spark):
    frame = winnowing.scan(hard(spark), spark.createDataFrame([(1, "one two")], PLAIN))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("sent", [winnowing.SENT_MARKS, 0])
def test_words_of_documents_are_not_shuffled(spark, sent, monkeypatch):
    """Where documents that hold a window are few or many, only runs with a mark of an item go on."""
    monkeypatch.setattr(winnowing, "SENT_MARKS", sent)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (" a b c d e f g h i j k l m" if i % 3 else "")) for i in range(30)]
    items = [(1, "a b c d e f g h i j k"), (2, "d e f"), (3, None)]
    stored = winnowing.word_table(spark.createDataFrame(docs, "row long, text string"), "text", winnowing.F.col("row"))
    stored = winnowing.saved(stored, "words")
    windows, _, lengths = winnowing.item_windows(winnowing.saved(winnowing.word_table(
        spark.createDataFrame(items, PLAIN), "text", winnowing.F.col("item_id").cast("string").alias("item")), "items"))
    found = winnowing.found_in(stored, windows, lengths, winnowing.WINDOW, winnowing.GRAM)
    assert found.count() == 20
    scans = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [row#" in line and "words#" in line]
    assert len(scans) == 1  # no second reading of the words to be joined
    got = collected(winnowing.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, PLAIN)))
    assert got == expected(docs, items)
