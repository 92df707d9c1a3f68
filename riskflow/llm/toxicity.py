"""Toxicity by multiple-instance learning: document labels train a sentence scorer.

A document is a bag of sentences. A sentence's probability is a logistic score of its word
features; the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only document
labels exist, so the loss is on the noisy-or and its gradient reaches a sentence in
proportion to its share of the blame. The trained scorer then locates the offending
sentences by their own probabilities.

Features of a word (lower case): the word, and its beginnings of ``PREFIXES`` characters,
which catch inflected and compounded forms. Those whose presence differs most between
toxic and clean labelled documents are kept (at most ``FEATURES``).

Training is bounded: at most ``SAMPLE`` labelled documents of each class, the first in a
hash order of their ids (ids alone are ranked; the chosen texts are then fetched through a
join with that list) of at most ``TEXT_CHARS`` characters, and ``SAMPLE_CHARS`` in all, in hash
order; clean documents are weighted back to their true share. The fit is one task's work: the
driver gets ids, lengths and the model, never a text. Scoring covers every whole text, one pass, no shuffle.

Defined results: null text is empty; a text without a sentence scores the noisy-or of no
sentence, 0; an empty table gives no rows, and equal rows equal scores; labels that are null, or of unknown documents, are not learned from; without
both classes in the labels, every score is the share of toxic ones (0 if none).
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import common
from riskflow.operators.materialize import materialize

PREFIXES = (3, 4, 5, 6, 7)
FEATURES = 3000
SAMPLE = 2500
SAMPLE_CHARS = 40_000_000
TEXT_CHARS = 400_000
WORD_MEMO = 300_000
CHUNK = 200                 # documents whose features are counted at once

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_MEMO: dict[int, dict[str, float]] = {}


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every stretch between sentence ends that holds a word character."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(text, *m.span())]


def features(word: str) -> list[str]:
    return [word] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]


class Model:
    """Bias, feature weights, and the rate used where nothing could be learned."""

    def __init__(self, bias: float, weights: dict[str, float], constant: float | None = None):
        self.bias, self.weights, self.constant = bias, weights, constant
        self.key = hash((bias, tuple(sorted(weights.items()))))

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        if self.key not in _MEMO:                 # a worker outlives a run; only its last model's words stay
            _MEMO.clear()
        memo = _MEMO.setdefault(self.key, {})
        if len(memo) > WORD_MEMO:
            memo.clear()
        spans, scores = [], []
        lowered = text.lower()
        if len(lowered) != len(text):             # a few capitals lower to two characters
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in _SENTENCE.finditer(lowered):
            words = _WORD.findall(m[0])
            if words:
                total = self.bias
                for w in set(words):
                    x = memo.get(w)
                    if x is None:
                        x = memo[w] = self.word_weight(w)
                    total += x
                spans.append(m.span())
                scores.append(total)
        z = np.clip(np.array(scores, dtype=float), -40, 40)
        return spans, 1 / (1 + np.exp(-z))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and its offending sentences (start, end, p >= 0.5)."""
        spans, p = self.sentence_scores(text)
        if self.constant is not None:
            return self.constant, []
        doc = -math.expm1(float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        return min(1.0, max(0.0, doc)), [(a, b, float(x)) for (a, b), x in zip(spans, p) if x >= 0.5]


def _spread(flat: np.ndarray, count: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of every item's list: the item's place in ``items``, and the entry."""
    n, first = count[items], np.cumsum(count) - count
    at = np.repeat(np.arange(len(items)), n)
    return at, flat[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[items], n)]


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0, steps: int = 300,
        rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Train on documents and their 0/1 labels; ``clean_weight`` is a clean document's weight."""
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(-40.0, {}, constant=share)
    # sentences as word numbers, words as feature numbers
    number: dict[str, int] = {}
    found, sizes, owner = array("i"), [], []
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text.lower()):
            if words := set(_WORD.findall(m[0])):
                found.extend(number.setdefault(w, len(number)) for w in words)
                sizes.append(len(words))
                owner.append(d)
    word, owner = np.array(found, np.int64), np.array(owner, np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    named: dict[str, int] = {}
    entries, sizes_of = array("i"), array("i")
    for w in number:
        listed = features(w)
        entries.extend(named.setdefault(f, len(named)) for f in listed)
        sizes_of.append(len(listed))
    flat, count = np.array(entries, np.int64), np.array(sizes_of, np.int64)
    n_words, n_features = max(1, len(number)), max(1, len(named))
    # documents that hold each feature, by label, some documents at a time
    pairs = np.unique(owner[sentence] * n_words + word)
    inside, outside = np.zeros(len(named)), np.zeros(len(named))
    edges = np.searchsorted(pairs, np.arange(0, len(y) + CHUNK, CHUNK) * n_words)
    for first, last in zip(edges, edges[1:]):
        part = pairs[first:last]
        at, feature = _spread(flat, count, part % n_words)
        held = np.unique((part // n_words)[at] * n_features + feature)
        toxic = y[held // n_features] == 1
        inside += np.bincount(held[toxic] % n_features, minlength=len(named))
        outside += np.bincount(held[~toxic] % n_features, minlength=len(named))
    n1, n0 = y.sum(), len(y) - y.sum()
    a_rate, b_rate = inside / n1, outside / n0
    strength = (a_rate - b_rate) / np.sqrt(a_rate * (1 - a_rate) / n1 + (b_rate + 1 / n0) / n0 + 1e-12)
    names = list(named)
    usable = np.flatnonzero((inside >= 3) & (a_rate > b_rate)).tolist()
    picked = sorted(usable, key=lambda f: (-strength[f], names[f]))[:FEATURES]
    chosen = [names[f] for f in picked]
    index = np.full(len(names), -1)
    index[picked] = np.arange(len(picked))

    # the words' chosen features alone
    kept = index[flat] >= 0
    count = np.bincount(np.repeat(np.arange(len(number)), count)[kept], minlength=len(number))
    at, col_of = _spread(index[flat[kept]], count, word)
    voiced, row_of = np.unique(sentence[at], return_inverse=True)
    doc_of = owner[voiced]
    silent = (np.bincount(owner, minlength=len(y)) - np.bincount(doc_of, minlength=len(y))).astype(float)
    weight = np.where(y == 1, 1.0, clean_weight)
    weight /= weight.sum()
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row_of, theta[col_of], minlength=len(doc_of))
        p, quiet = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + silent * np.log1p(-quiet)
        doc = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d log prod(1-p): 1 for clean documents' weight, -(1-P)/P for toxic ones.
        blame = weight * np.where(y == 1, -(1 - doc) / doc, 1.0)
        dz = blame[doc_of] * p
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(col_of, dz[row_of], minlength=len(chosen)) + decay * theta[:-1]
        grad[-1] = dz.sum() + (blame * silent).sum() * quiet
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Model(float(theta[-1]), dict(zip(chosen, theta[:-1].tolist())))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of (doc_id, toxic) labels and the (doc_id, text) they name."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for label in totals:
        part = usable.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return fit([], [])
    listed = picked.collect()                          # at most 2 * sample ids
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in listed], "doc_id long, toxic int")
    rows = materialize(docs.filter(F.length("text") <= TEXT_CHARS).join(F.broadcast(ids), "doc_id")
                       .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
                       .withColumn("spot", order), "toxicity-sample")
    chars, last = 0, None                              # the hash up to which the texts are within SAMPLE_CHARS
    for r in sorted(rows.select("spot", F.length("text").alias("n")).collect()):
        chars += r["n"]
        if chars > SAMPLE_CHARS:
            break
        last = r["spot"]
    if last is None:
        return fit([], [])

    def fit_sample(held: pd.DataFrame) -> Model:
        held = held.sort_values("doc_id")
        found = held["toxic"].value_counts()
        ratio = (totals[0] / found[0]) / (totals[1] / found[1]) if len(found) == 2 else 1.0
        return fit(held["text"].tolist(), held["toxic"].tolist(), clean_weight=ratio)

    return common.fitted(rows.filter(F.col("spot") <= last).select("doc_id", "toxic", "text"), fit_sample)


def _forget() -> bool:
    held = bool(_MEMO)
    _MEMO.clear()
    return held


common.remembers(__name__, _forget)

SCORED = "score double, offending array<struct<start:int,end:int,score:double>>"


def score_column(model: Model):
    """A column function: whole text -> (score, offending sentences)."""
    @F.pandas_udf(SCORED)
    def scored(texts: pd.Series) -> pd.DataFrame:
        common.forget(but=__name__)
        found = [model.score(t or "") for t in texts]
        out = pd.DataFrame({"score": [f[0] for f in found],
                            "offending": [[{"start": a, "end": b, "score": p} for a, b, p in f[1]] for f in found]})
        del found
        common.give_back()
        return out
    return scored


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that the contract lets a model learn from."""
    return labels.filter(common.crc_mod(F.col("doc_id"), 5) != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document, with the worst sentence's place."""
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    model = train(docs, learnable(common.table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", score_column(model)("text").alias("s"))
    worst = F.array_max(F.transform("s.offending", lambda x: F.struct(x["score"], -x["start"], x["end"])))
    return scored.select(
        "doc_id", (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
        F.size("s.offending").cast("long").alias("n_offending"),
        (-worst["col2"]).cast("long").alias("worst_start"), worst["end"].cast("long").alias("worst_end"))
