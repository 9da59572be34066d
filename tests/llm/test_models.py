import zlib

import numpy as np
import pytest

from gavelwork.llm import language, quality
from gavelwork.llm.features import ngrams
from tests.llm.helpers import ROWS, empty, hard

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, docs):
    return quality.train(quality.labelled(docs, spark.read.parquet(f"{SF}/labels.parquet")))


def test_features_of_a_word_do_not_hang_on_its_neighbours():
    alone = [sorted(ngrams([w], (1, 2, 3), 1000)[0]) for w in ("ab", "c", "ñandú")]
    feature, owner = ngrams(["ab", "c", "ñandú"], (1, 2, 3), 1000)
    assert [sorted(feature[owner == i]) for i in range(3)] == alone
    assert ngrams([], (1, 2), 10)[0].size == 0


def test_held_out_labels_never_reach_the_sample(spark, docs):
    rows = quality.labelled(docs, spark.read.parquet(f"{SF}/labels.parquet"), limit=50).collect()
    assert len(rows) == 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_held_out_accuracy(spark, docs, model):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = docs.select("doc_id", quality.score_of(spark, model).alias("score")).collect()
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.97


def test_hard_rows_have_scores(spark, model):
    rows = hard(spark).select("doc_id", "text", quality.score_of(spark, model).alias("s")).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["s"] <= 1 for r in rows)
    assert len({r["s"] for r in rows if not (r["text"] or "").strip()}) == 1
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (8, 0), (None, 1), (3, None), (6, 7)], "doc_id long, quality int")
    kept = quality.filter_quality(hard(spark), labels)
    assert kept.columns == hard(spark).columns
    assert quality.filter_quality(empty(spark), labels).count() == 0
    assert quality.filter_quality(hard(spark), labels.limit(0)).count() == len(ROWS)


def test_a_text_beyond_the_character_bound_leaves_the_others(spark):
    texts = ["good text here " * 30] + ["good text here"] * 20 + ["bad!! bad!! bad!!"] * 20
    rows = [(i, i, t, int("good" in t)) for i, t in enumerate(texts)]
    sample = spark.createDataFrame(rows, "draw long, doc_id long, text string, label int")
    model, want = quality.train(sample, 400), quality.fit(texts[1:28], [1] * 20 + [0] * 7)
    assert np.allclose(model.scalars()[0], want.scalars()[0], atol=1e-5) and np.abs(want.vectors).sum() > 0
    with pytest.raises(Exception, match="no document within"):
        quality.train(sample, 10)


def test_training_repeats():
    texts, labels = ["good text here"] * 20 + ["bad!! bad!! bad!!"] * 20, [1] * 20 + [0] * 20
    a, b = quality.fit(texts, labels), quality.fit(texts, labels)
    assert np.array_equal(a.vectors, b.vectors)


def path_of(scores, penalty):
    """Best path by trying all pairs of states."""
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for t in range(1, n):
        move = value[:, None] - penalty * (1 - np.eye(k))
        back.append(move.argmax(0))
        value = move.max(0) + scores[t]
    return value.max()


def worth(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * np.count_nonzero(np.diff(path))


@pytest.mark.parametrize("seed", range(20))
def test_path_is_the_best(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 60, 12)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = -4 * rng.random((bounds[-1], 3)) ** rng.choice([0.3, 1, 4])
    path = language.viterbi(scores, bounds, 3.0)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            assert worth(scores[a:b], path[a:b], 3.0) == pytest.approx(path_of(scores[a:b], 3.0))


@pytest.fixture(scope="module")
def languages(docs):
    return language.train(language.training_rows(docs))


def test_held_out_languages(spark, docs, languages):
    rows = docs.select("doc_id", "lang", language.labelled_of(spark, languages).alias("r")).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["r"]["lang"] for r in held]) > 0.98
    assert all(0 <= r["r"]["score"] <= 1 for r in rows)


def test_spans_of_mixed_text(spark, docs, languages):
    some = {r["lang"]: r["text"].split()[:60] for r in docs.filter("n_chars > 2000").collect()}
    mixed = some["en"] + some["de"]
    row = spark.createDataFrame([(" ".join(mixed),)], "text string").select(language.labelled_of(spark, languages).alias("r")).first()["r"]
    spans = [(s["begin"], s["end"], s["lang"]) for s in row["spans"]]
    assert spans[0][2] == "en" and spans[-1][2] == "de" and spans[0][0] == 0 and spans[-1][1] == len(mixed)
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert abs(spans[0][1] - len(some["en"])) <= 3


def test_script_ranges_narrow_the_languages(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("привет как дела друзья", "ru"), ("hello how are you friends", "en"), ("γεια σου κόσμε", "el")] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(language.training_rows(docs))
    scores, has = language.word_scores(["дом", "house", "λόγος", "12", "日本"], model)
    assert [model.languages[j] for j in scores[:3].argmax(1)] == ["ru", "en", "el"] and has.tolist() == [True, True, True, False, True]
    assert (scores[3:] == 0).all()


def test_texts_without_letters_are_undetermined(spark, languages):
    rows = hard(spark).select("text", language.labelled_of(spark, languages).alias("r")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["r"]["lang"] == "und") == (not letters) and (letters or (r["r"]["score"] == 0 and r["r"]["spans"] == []))
    nothing = language.train(language.training_rows(empty(spark)))
    assert {r["r"]["lang"] for r in hard(spark).select(language.labelled_of(spark, nothing).alias("r")).collect()} == {"und"}
