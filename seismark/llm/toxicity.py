"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts whose labels are not looked at
are the unlabelled set. A logistic classifier over the presence of words is
fitted in numpy with the non-negative risk estimator: the positive class prior
corrects the unlabelled risk, and a negative part below zero is undone instead
of followed. Words stand beside their first letters, so a form that training
has not seen counts by its stem. The prior is the share of confirmed toxic
rows among labelled training rows.

Only the fit works on a sample: at most ``POSITIVES`` toxic and ``UNLABELLED``
texts, the first by a hash of doc_id, of the training folds. Scoring covers
every whole text, without a shuffle.

Defined results: null and empty texts score by the intercept alone; repeated
rows score alike; a row without a doc_id is scored, but not held out and never
trained on; labels of documents that are not there, and null labels, are
ignored; of two labels of one document the larger counts; with no positives in
training every score is next to 0; ties in the sample go by hash and doc_id;
long texts are read whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import cut, parts

FOLDS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED, VOCABULARY = 4_000, 12_000, 2_000
#: Letters of a word that stand for its stem.
PREFIX = 4
STEPS, RATE, DECAY = 400, 0.05, 2e-4

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def marks_of(text: bytes | None) -> set[str]:
    """The words of a text, and the first PREFIX letters of longer ones with a star: inflected and made-up forms share them."""
    words = set((text or b"").translate(_WORD_BYTES).decode(errors="replace").split(" ")) - {""}
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float

    def score(self, text: bytes | None) -> float:
        z = self.intercept + math.fsum(self.weights[w] for w in marks_of(text) & self.weights.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic model that minimises the non-negative PU risk."""
    docs = [*positive, *unlabelled]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cols = np.fromiter((c for d in docs for c in d), np.int64, len(owner))
    n_p, n_u = len(positive), len(unlabelled)
    is_p = np.arange(len(docs)) < n_p
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(owner, w[cols], len(docs))
        s = _sigmoid(z)
        as_negative = np.logaddexp(0, z)
        negative_risk = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
        # gradient of the risk by each document's margin
        g_negative = np.where(is_p, -prior * s / n_p, s / n_u)
        g_positive = np.where(is_p, prior * (s - 1) / n_p, 0)
        g = g_positive + g_negative if negative_risk >= 0 else -g_negative
        grad = np.append(np.bincount(cols, g[owner], width) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """doc_id, positive of the fit's bounded sample, and the class prior."""
    known = labels.filter(fold(F.col("doc_id")) != HELD_OUT).filter("toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    prior = min(0.95, (stats.t or 0) / stats.n) if stats.n else 0.0
    first = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = first(known.filter("toxic = 1"), POSITIVES).withColumn("positive", F.lit(True))
    rest = first(docs.filter(fold(F.col("doc_id")) != HELD_OUT), UNLABELLED).withColumn("positive", F.lit(False))
    return cut(positive.unionByName(rest)), prior


def _words(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], int] = {}
            for t, p in zip(batch.column("text").cast(pa.binary()), batch.column("positive").to_pylist(), strict=True):
                for w in marks_of(t.as_py()):
                    counts[w, p] = counts.get((w, p), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())],
                ["word", "positive", "n"],
            )

    return texts.mapInArrow(run, "word string, positive boolean, n long")


def _features(texts: DataFrame, index: dict[str, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = [sorted(index[w] for w in marks_of(t.as_py()) & index.keys()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column("positive")], ["cols", "positive"])

    return texts.mapInArrow(run, "cols array<int>, positive boolean")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    ids, prior = _sampled(docs, labels)
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # the sample has at most POSITIVES + UNLABELLED ids
    texts = held.join(F.broadcast(ids), "doc_id").select("text", "positive")
    sizes = {r.positive: r.n for r in ids.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u or prior <= 0:
        return Model({}, -30.0)
    counts = _words(texts).groupBy("word").agg(
        F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("u")
    )
    rate_p, rate_u = F.col("p") / n_p, F.col("u") / n_u
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    lift = F.abs(rate_p - rate_u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    chosen = counts.filter("p + u >= 5").select("word", lift.alias("z")).filter("z >= 4").orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()
    index = {r.word: k for k, r in enumerate(chosen)}
    rows = _features(texts, index).collect()
    positive, rest = sorted(r.cols for r in rows if r.positive), sorted(r.cols for r in rows if not r.positive)
    if not positive or not rest:
        return Model({}, -30.0)
    w, b = fit_nnpu(positive, rest, len(index), prior)
    return Model({word: float(w[k]) for word, k in index.items()}, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sent.value
        for batch in parts(batches):
            scores = pa.array([one.score(t.as_py()) for t in batch.column("text").cast(pa.binary())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    done = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
