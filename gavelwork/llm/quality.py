"""Quality classifier: averaged vectors of hashed word and character n-grams, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelwork.llm import words
from gavelwork.llm.common import fold, freeing, give_back, saved, text_or_empty
from gavelwork.llm.features import code_points, ngrams, word_hashes

BUCKETS, DIMENSIONS, SIZES = 1 << 16, 4, (2, 3, 4)
#: Bounds of the labelled sample that the model is fitted on: documents and characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 3_000, 15_000_000
#: Steps of descent, whatever the sample's size: four passes over a full one.
STEPS, BATCH, RATE, SEED = 240, 50, 0.5, 7
#: Bytes of text scored in one step.
SCORE_BYTES = 4_000_000
#: Labels of one document in FOLDS are held out.
FOLDS, THRESHOLD = 5, 0.3
_AGAIN = BUCKETS  # the pair of a word with itself, whatever the word
_ROWS = 2 * BUCKETS + 1


@dataclass
class Model:
    """``vectors`` of all features, and ``weights`` (classes x dimensions) and ``bias`` of the softmax."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scalars(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log odds of class 1 before averaging, and the bias."""
        return self.vectors @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0])


def _pairs(codes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of neighbouring words and the bounds of each text's pairs; a repeated word has one for all words."""
    left, right = codes[:-1], codes[1:]
    inside = np.ones(max(0, len(codes) - 1), bool)
    cuts = bounds[1:-1] - 1
    inside[cuts[(cuts >= 0) & (cuts < len(inside))]] = False
    with np.errstate(over="ignore"):
        mixed = hashes[left] * np.uint64(31) + hashes[right]
    feature = np.where(left == right, _AGAIN, BUCKETS + 1 + ((mixed >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64))
    total = np.concatenate([[0], np.cumsum(inside)])
    return feature[inside], total[np.clip(bounds, 0, len(inside))]


def _score(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 of whole texts."""
    bounds, codes, distinct = words.split(texts)
    feature, owner = ngrams(distinct, SIZES, BUCKETS)
    value = np.bincount(owner, table[feature], len(distinct))
    count = np.bincount(owner, minlength=len(distinct))
    pairs, pair_bounds = _pairs(codes, word_hashes(*code_points(distinct)), bounds)
    total = words.sums(value[codes], bounds) + words.sums(table[pairs], pair_bounds)
    n = words.sums(count[codes], bounds) + np.diff(pair_bounds)
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))


def fit(texts: list[str], labels: list[int], seed: int = SEED, steps: int = STEPS, batch: int = BATCH, rate: float = RATE) -> Model:
    """Minibatch stochastic gradient descent with per-weight step sizes (AdaGrad)."""
    rng = np.random.default_rng(seed)
    bounds, codes, distinct = words.split(words.as_array(pa.array(texts, pa.string())))
    feature, owner = ngrams(distinct, SIZES, BUCKETS)
    feature = feature[np.argsort(owner, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(distinct)))])
    pairs, pair_bounds = _pairs(codes, word_hashes(*code_points(distinct)), bounds)
    target = np.asarray(labels, np.int64)
    model = Model(rng.uniform(-1, 1, (_ROWS, DIMENSIONS)) / DIMENSIONS, np.zeros((2, DIMENSIONS)), np.zeros(2))
    power = [np.full(a.shape, 1e-6) for a in (model.vectors, model.weights, model.bias)]

    def features_of(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the documents, how often each occurs, and the document it is of."""
        out = []
        for place, doc in enumerate(docs):
            own, times = np.unique(codes[bounds[doc]:bounds[doc + 1]], return_counts=True)
            sizes = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            pair = pairs[pair_bounds[doc]:pair_bounds[doc + 1]]
            ids = np.concatenate([feature[at], pair])
            weight = np.concatenate([np.repeat(times, sizes), np.ones(len(pair), np.int64)])
            summed = np.bincount(ids, weight, _ROWS)
            ids = np.flatnonzero(summed)
            out.append((ids, summed[ids] / max(1.0, summed.sum()), np.full(len(ids), place)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def step(values: np.ndarray, gradient: np.ndarray, past: np.ndarray) -> None:
        past += gradient ** 2
        values -= rate * gradient / np.sqrt(past)

    drawn = iter([])
    for _ in range(steps if len(target) else 0):
        docs = next(drawn, None)
        if docs is None:
            order = rng.permutation(len(target))
            drawn = iter([order[i:i + batch] for i in range(0, len(order), batch)])
            docs = next(drawn)
        ids, share, place = features_of(docs)
        held = model.vectors[ids]
        mean = np.stack([np.bincount(place, share * held[:, d], len(docs)) for d in range(DIMENSIONS)], 1)
        odds = mean @ model.weights.T + model.bias
        odds = np.exp(odds - odds.max(1, keepdims=True))
        error = odds / odds.sum(1, keepdims=True)
        error[np.arange(len(docs)), target[docs]] -= 1
        error /= len(docs)
        back = error @ model.weights
        gradient = np.stack([np.bincount(ids, share * back[place, d], _ROWS) for d in range(DIMENSIONS)], 1)
        step(model.weights, error.T @ mean, power[1])
        step(model.bias, error.sum(0), power[2])
        step(model.vectors, gradient, power[0])
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
             folds: int = FOLDS, held: int = 0, limit: int = SAMPLE_DOCS) -> DataFrame:
    """Bounded sample (draw, doc_id, text, label) of the labelled documents that are not held out.

    Of several labels of a document the smallest counts; labels that are null or other than 0
    and 1 and ids that are null do not. The sample is the ``limit`` documents that a hash puts first.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(SEED)))
    drawn = known.orderBy("draw", "doc_id").limit(limit)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text"))


def train(sample: DataFrame, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample in one task. In the order of the draw every document is taken that
    fits into what is left of ``chars`` characters in all; raises if a label of the sample has none that fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["draw"], r["doc_id"]))
        left, drawn = chars, []
        for r in rows:
            if len(r["text"]) <= left:
                drawn.append(r)
                left -= len(r["text"])
        if {r["label"] for r in rows} != {r["label"] for r in drawn}:
            raise ValueError(f"a label has no document within {chars} characters of the sample")
        model = fit([r["text"] for r in drawn], [r["label"] for r in drawn])
        yield pa.RecordBatch.from_pydict({
            "vectors": [model.vectors.astype("<f4").tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()],
        })

    one = saved(sample.coalesce(1).mapInArrow(freeing(run), "vectors binary, weights binary, bias binary"), "quality-model").first()
    if one is None:
        return fit([], [])
    return Model(
        np.frombuffer(one["vectors"], "<f4").reshape(_ROWS, DIMENSIONS).astype(float),
        np.frombuffer(one["weights"]).reshape(2, DIMENSIONS), np.frombuffer(one["bias"]),
    )


def score_of(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Probability of label 1 of the whole text of a row. Null and empty texts get the score
    of no features."""
    held = spark.sparkContext.broadcast(model.scalars())  # a number per feature, whatever the data

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = words.as_array(column)
        scores = [_score(texts.slice(a, b - a), *held.value) for a, b in words.steps(texts, SCORE_BYTES)]
        del texts
        give_back()
        return pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return score(text_or_empty(text))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = train(labelled(docs, labels, text=text))
    return docs.filter(score_of(docs.sparkSession, model, text) >= threshold)
