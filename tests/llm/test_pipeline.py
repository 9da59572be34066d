"""The stages on the small tables, each against plain Python on what the stage before has kept."""

import math
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from gavelwork.llm import quality, simhash
from tests.conftest import SF
from tests.llm.helpers import TOKENIZER, components, hard
from tests.llm.test_dedup import LOWER
from tests.llm.test_mixing import WORD, shared
from tests.llm.test_tokens import ids_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [(t.columns, t.collect()) for t in out]


def test_stages_keep_the_columns(tables):
    assert all(columns == tables[0][0] for columns, _ in tables[1:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "packing"]


def test_quality_drops_what_it_rejects_and_keeps_the_clean(spark, tables):
    kept = {r["doc_id"] for r in tables[1][1]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in labels if labels[i] == 1]
    assert len(kept) < len(tables[0][1]) and len([i for i in clean if i in kept]) >= 0.95 * len(clean)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(quality.labelled(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    scores = docs.select("doc_id", quality.score_of(spark, model).alias("s")).collect()
    assert kept == {r["doc_id"] for r in scores if r["s"] >= quality.THRESHOLD}


def test_newest_copy_stays(tables):
    newest = {}
    for r in tables[1][1]:
        key = r["text"].translate(LOWER)
        newest[key] = max(newest.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in tables[2][1]) == sorted(newest.values())


def shingles(text):
    found = [w for w in re.split("[ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)) if w]
    return frozenset(" ".join(found[i:i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def similar_sets(sets, least=0.8):
    """All pairs of different sets with the Jaccard similarity. A pair of sets shares one of the rarest
    shingles of either, so only those are looked up; no pair is left out."""
    common = Counter(s for own in sets for s in own)
    index, out = {}, set()
    for i, own in enumerate(sets):
        rare = sorted(own, key=lambda s: (common[s], s))[:len(own) - math.ceil(least * len(own)) + 1]
        for j in {j for s in rare for j in index.get(s, ())}:
            both = len(own & sets[j])
            if both >= least * (len(own) + len(sets[j]) - both):
                out.add((j, i))
        for s in rare:
            index.setdefault(s, []).append(i)
    return out


def test_one_of_each_near_group_stays(tables):
    """Jaccard similarity of five-word shingles, 0.8 or more, by brute force."""
    own = {r["doc_id"]: shingles(r["text"]) for r in tables[2][1]}
    label = components(list(own), lambda a, b: own[a] == own[b] or len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]))
    assert sorted(r["doc_id"] for r in tables[3][1]) == sorted(set(label.values()))


def test_recall_of_near_copies_on_a_larger_table(spark):
    """Of all pairs of documents at 0.8 or more that are not equal sets, at least 99 % lose a member."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger table")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(shingles(r["text"]), r["doc_id"])
    sets = list(first)
    pairs = similar_sets(sets)
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).select("doc_id").collect()}
    assert kept <= set(first.values())
    caught = [(a, b) for a, b in pairs if not {first[sets[a]], first[sets[b]]} <= kept]
    assert len(pairs) > 20 and len(caught) >= 0.99 * len(pairs)
    linked = {i for pair in pairs for i in pair}
    assert all(first[s] in kept for i, s in enumerate(sets) if i not in linked)  # nothing else goes


def test_mix_meets_its_targets(tables):
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in tables[3][1]}
    total, taken = Counter(), Counter()
    for r in tables[3][1]:
        total[r["source"]] += size[r["doc_id"]]
    times = Counter(r["doc_id"] for r in tables[4][1])
    assert max(times.values()) <= 2
    for r in tables[3][1]:
        taken[r["source"]] += times[r["doc_id"]] * size[r["doc_id"]]
    for source, target in shared(dict(total)).items():
        assert abs(taken[source] - target) <= max(size.values()), source


def test_packing_holds_every_document(tables):
    want = Counter({r["doc_id"]: 0 for r in tables[4][1]})
    for r in tables[4][1]:
        want[r["doc_id"]] += len(ids_of(r["text"]))
    got = Counter()
    for r in tables[5][1]:
        got[r["doc_id"]] += r["length"]
    assert got == want
    room = Counter()
    for r in tables[5][1]:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096 and len(room) <= 1.05 * sum(room.values()) / 4096 + 2


def test_run_gives_the_last_table(spark, tables):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == tables[5][0] and rows.count() == len(tables[5][1])
    assert os.path.exists(TOKENIZER) and corpus_pipeline.ORACLE_SQL is None


def test_hard_rows_pass_all_stages(spark):
    docs = hard(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0 and name == "packing"
