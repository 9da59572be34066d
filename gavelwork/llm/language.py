"""Language of texts and of their spans: script ranges, word scores, and a Viterbi path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelwork.llm import words
from gavelwork.llm.common import fold, saved, text_or_empty
from gavelwork.llm.features import code_points, ngrams

BUCKETS, SIZES = 1 << 16, (1, 2, 3)
#: Documents of each language that the counts are learned from, at most.
SAMPLE_DOCS = 2_000
#: Parts of a hash by which the sample is first narrowed, so that no task orders a whole language.
DRAW_BUCKETS = 1 << 16
#: Sampled ids that are sent to every task at most.
BROADCAST_ROWS = 200_000
FOLDS, HELD, SEED = 4, 2, 11
#: What a change of language costs, and the most that one word can tell between two languages.
PENALTY, WORD_LIMIT = 12.0, 4.0
#: Part of a language's letters that must be of a script for the script to allow the language.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
#: Bytes of text that are labelled in one step.
STEP_BYTES = 4_000_000

# First code point of each range, and the script it belongs to (Unicode blocks).
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in _RANGES))
_STARTS = np.array([start for start, _ in _RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in _RANGES])
_LETTER: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0][points]


def _scripts(distinct: list[str]) -> np.ndarray:
    """Letters of each script in each word."""
    points, starts = code_points(distinct)
    out = np.zeros((len(distinct), len(SCRIPTS)), np.int64)
    if len(distinct):
        owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(points)]))
        mine = np.flatnonzero(_letters(points))
        script = _SCRIPT[np.searchsorted(_STARTS, points[mine], "right") - 1]
        np.add.at(out, (owner[mine], script), 1)
    return out


@dataclass
class Model:
    """``scores``: log probability of each n-gram by language; ``allowed``: languages by script."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  limit: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of a bounded sample of each language, held-out documents excepted.

    The sample of a language is the ``limit`` rows that a hash of the id puts first; ids and
    languages are read alone for that. Null languages are no language.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD))
    draw = F.xxhash64("doc_id", F.lit(SEED))
    known = known.select("doc_id", "lang", draw.alias("draw"), F.pmod(draw, F.lit(DRAW_BUCKETS)).cast("int").alias("bucket"))
    # the bucket in which each language's sample is full; later ones need not be ordered
    upto = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = known.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = full.filter(F.col("before") < limit).groupBy("lang").agg(F.max("bucket").alias("last"))
    near = known.join(last, "lang").filter(F.col("bucket") <= F.col("last"))
    first = Window.partitionBy("lang").orderBy("bucket", "draw", "doc_id")
    chosen = near.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= limit)
    drawn = saved(chosen.select("doc_id", "lang").distinct(), "drawn")
    if drawn.count() <= BROADCAST_ROWS:  # else, with very many languages, a shuffled join gives the same rows
        drawn = F.broadcast(drawn)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), text_or_empty(text).alias("text"))
    return texts.join(drawn, ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"]).select("lang", "text")


def train(rows: DataFrame) -> Model:
    """Count hashed character n-grams and script letters of each language.

    Tasks add up their own counts; a language's counts are one array of fixed size, whatever
    its rows. Without any row the model knows no language.
    """
    size = BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = words.as_array(batch.column(1))
            for a, b in words.steps(texts, STEP_BYTES):
                bounds, codes, distinct = words.split(pc.utf8_lower(texts.slice(a, b - a)))
                feature, owner = ngrams(distinct, SIZES, BUCKETS, whole=False)
                scripts = _scripts(distinct)
                of = np.repeat(np.arange(b - a), np.diff(bounds))
                for lang in set(langs[a:b]):
                    mine = (langs[a:b] == lang)[of]
                    times = np.bincount(codes[mine], minlength=len(distinct))
                    own = total.setdefault(lang, np.zeros(size))
                    own[:BUCKETS] += np.bincount(feature, times[owner], BUCKETS)
                    own[BUCKETS:] += times @ scripts
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "at", "n"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(size)
        own[rows["at"].to_numpy()] = rows["n"].to_numpy()
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [own.tobytes()]})

    counted = rows.mapInArrow(count, "lang string, at long, n double").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found = saved(counted.groupBy("lang").applyInPandas(whole, "lang string, counts binary"), "languages").orderBy("lang").collect()
    if not found:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    counts = np.stack([np.frombuffer(r["counts"]) for r in found], 1)
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS))
    return Model([r["lang"] for r in found], scores, letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1))


def word_scores(distinct: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word under each language (0 for the best, no less than -WORD_LIMIT), and
    whether it has a letter. The word's main script leaves the languages it may be of; a word
    without letters, or of a script that no language has, tells nothing."""
    feature, owner = ngrams(distinct, SIZES, BUCKETS, whole=False)
    n, k = len(distinct), len(model.languages)
    raw = np.stack([np.bincount(owner, model.scores[feature, j], n) for j in range(k)], 1)
    scripts = _scripts(distinct)
    has = scripts.sum(1) > 0
    allowed = model.allowed[scripts.argmax(1)]
    raw = np.where(allowed, raw, -np.inf)
    known = has & allowed.any(1)
    raw[~known] = 0
    out = np.maximum(raw - raw.max(1, keepdims=True), -WORD_LIMIT)
    return out, has


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word: highest sum of scores less ``penalty`` for each change.

    A text whose best single language can't be beaten keeps it without a search: that is sure
    when no stretch of words gains more than half the penalty under another language. The rest
    is searched, many texts of like length at a time. Ties go to the first language.
    """
    path = np.zeros(len(scores), np.int64)
    total = words.sums(scores, bounds)
    best = total.argmax(1)
    unsure = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a == b:
            continue
        path[a:b] = best[i]
        gain = np.cumsum(scores[a:b] - scores[a:b, best[i], None], axis=0)
        floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        floor = np.concatenate([np.zeros((1, scores.shape[1])), floor[:-1]])
        if (gain - floor).max() > penalty / 2:
            unsure.append(i)
    unsure.sort(key=lambda i: bounds[i + 1] - bounds[i])
    while unsure:
        longest = int(bounds[unsure[-1] + 1] - bounds[unsure[-1]])
        some = unsure[-max(1, 2_000_000 // longest):]
        del unsure[-len(some):]
        _search(scores, bounds, np.array(some), path, penalty)
    return path


def _search(scores: np.ndarray, bounds: np.ndarray, docs: np.ndarray, path: np.ndarray, penalty: float) -> None:
    begin, size = bounds[docs], bounds[docs + 1] - bounds[docs]
    k, longest = scores.shape[1], int(size.max())
    back = np.zeros((longest, len(docs), k), np.int16)
    value, rows = np.zeros((len(docs), k)), np.arange(len(docs))
    for t in range(longest):
        live = rows[size > t]
        held = value[live]
        if t:
            top = held.argmax(1)
            other = held[np.arange(len(live)), top][:, None] - penalty
            change = other > held
            back[t, live] = np.where(change, top[:, None], np.arange(k))
            held = np.where(change, other, held)
        value[live] = held + scores[begin[live] + t]
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        live = rows[size > t]
        path[begin[live] + t] = state[live]
        if t:
            state[live] = back[t, live, state[live]]


RESULT = "lang string, score double, spans array<struct<begin:int,end:int,lang:string>>"


def labelled_of(spark: SparkSession, model: Model, text: str = "text", penalty: float = PENALTY, with_spans: bool = True):
    """Column (lang, score, spans) for whole texts.

    ``spans`` are runs of words [begin, end) of one language, covering the text; ``lang`` has
    most letters in them (ties: the first by name) and ``score`` is its part of the letters.
    A text that is null or has no letter is ``und`` with score 0 and no spans; so is every text
    when no language was learned.
    """
    # plain arrays, so that workers need no class of this package; languages times buckets, whatever the data
    held = spark.sparkContext.broadcast((model.languages, model.scores, model.allowed))
    kind = pa.struct([
        ("lang", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))),
    ])

    @F.arrow_udf(RESULT)
    def label(column: pa.Array) -> pa.Array:
        own, out = Model(*held.value), []
        names = own.languages
        texts = words.as_array(column)
        for a, b in words.steps(texts, STEP_BYTES) if names else []:
            bounds, codes, distinct = words.split(pc.utf8_lower(texts.slice(a, b - a)))
            by_word, has = word_scores(distinct, own)
            letters = _scripts(distinct).sum(1)[codes]
            path = viterbi(by_word[codes], bounds, penalty)
            share = np.stack([words.sums(np.where(path == j, letters, 0), bounds) for j in range(len(names))], 1)
            full, best = share.sum(1), share.argmax(1)
            for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if not full[i]:
                    out.append({"lang": UNKNOWN, "score": 0.0, "spans": []})
                    continue
                spans = []
                if with_spans:
                    cuts = [x, *(np.flatnonzero(np.diff(path[x:y])) + x + 1).tolist(), y]
                    spans = [{"begin": p - x, "end": q - x, "lang": names[path[p]]} for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
                out.append({"lang": names[best[i]], "score": float(share[i, best[i]] / full[i]), "spans": spans})
        if not names:
            out = [{"lang": UNKNOWN, "score": 0.0, "spans": []}] * len(column)
        return pa.array(out, kind)

    return label(text_or_empty(text))
