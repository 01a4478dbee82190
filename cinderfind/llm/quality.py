"""Quality classifier: a linear support vector machine on naive-Bayes-scaled n-gram indicators.

A text's features are which character n-grams (one to three code points) it has, and which n-grams of marks that tell
for each word whether it repeats the one before (one to MARKS of them), hashed to BUCKETS. They are scaled by their
log-count ratio between the classes and by the root of their number, so that length alone says nothing. The hinge
loss is fitted by dual coordinate descent; a logistic curve on rows kept from the descent turns margins into scores.

The fit sees a bounded sample: PER_CLASS labelled rows of each class at most, those of least hash. Counts of classes
(the prior) are taken over all labelled rows that may be learned from. Scoring is row by row, without a shuffle.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
PER_CLASS = 6000
MARKS = 5
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str, mask: np.ndarray) -> np.ndarray:
    """The buckets of the text's n-grams, ascending. mask: BUCKETS zeros, given back so."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(3):
        if len(codes) <= n:
            break
        gram = (gram[: len(codes) - n] + codes[n:] + np.uint64(n + 1)) * _MIX
        gram ^= gram >> np.uint64(29)
        mask[(gram >> np.uint64(48)).astype(np.int64)] = 1
    words = text.split()
    again = np.fromiter(map(operator.eq, words[1:], words), np.uint64, max(0, len(words) - 1))
    gram = np.zeros(len(again), np.uint64)
    for n in range(MARKS):
        if len(again) <= n:
            break
        gram = gram[: len(again) - n] * np.uint64(2) + again[n:]
        mask[(((gram + np.uint64(1000 * (n + 1))) * _MIX) >> np.uint64(48)).astype(np.int64)] = 1
    found = np.flatnonzero(mask)
    mask[found] = 0
    return found


def _sampled(it):
    mask = np.zeros(BUCKETS, np.uint8)
    for batch in it:
        found = [features(t or "", mask).astype("<u2").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.record_batch([*batch.columns[:2], pa.array(found, pa.binary())], names=["doc_id", "y", "found"])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (sum of weights / root of their number) + intercept)))."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def score(self, found: np.ndarray) -> float:
        margin = self.bias + (float(self.weights[found].sum()) / len(found) ** 0.5 if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -500, 500))))


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss (L2-regularised): weights over raw indicators, and the bias."""
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    scaled = [r[f] / max(1, len(f)) ** 0.5 for f in rows]
    square = np.array([float(x @ x) + 1 for x in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ scaled[i]) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w * r, bias


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's curve by damped Newton steps, with his softened targets."""
    a, b = 1.0, 0.0
    hi, lo = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (hi + 1) / (hi + 2), 1 / (lo + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        step *= min(1, 2 / max(1e-9, abs(step).max()))
        a, b = a - step[0], b - step[1]
    return a, b


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns label quality of labels(doc_id, quality) from docs(doc_id, text), but for held-out rows.

    Labels that are null or neither 0 nor 1 teach nothing; without any, every score is 0.5; with one class, near it.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    total = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]).distinct())  # 2 * per_class ids at most
    learnt = docs.join(chosen, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text").mapInArrow(_sampled, "doc_id string, y int, found binary")
    rows = learnt.groupBy("doc_id", "y").agg(F.min("found").alias("found")).toPandas()  # one of an id's rows, however many it has
    y = rows["y"].to_numpy()
    if len(y) == 0:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    found = [np.frombuffer(x, "<u2").astype(np.int64) for x in rows["found"]]
    share = total.get(1, 0) / max(1, sum(total.values()))
    if y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share * 98 + 1) / (99 - share * 98))))
    counts = np.ones((2, BUCKETS))
    for f, label in zip(found, y):
        counts[label][f] += 1
    p = counts / counts.sum(1, keepdims=True)
    r = np.log(p[1] / p[0])
    learn = np.empty(len(y), bool)  # a fifth is kept for the curve, whatever order the rows came in
    learn[np.lexsort((rows["found"].map(zlib.crc32), y))] = np.arange(len(y)) % 5 > 0
    near = np.bincount(y[learn], minlength=2)
    cost = np.where(y == 1, learn.sum() / 2 / max(1, near[1]), learn.sum() / 2 / max(1, near[0]))
    w, bias = descend([f for f, ok in zip(found, learn) if ok], np.where(y[learn] == 1, 1.0, -1.0), r, cost[learn])
    margin = np.array([bias + (w[f].sum() / len(f) ** 0.5 if len(f) else 0.0) for f in found])
    rest = ~learn if len(set(y[~learn])) == 2 else np.ones(len(y), bool)
    weight = np.where(y == 1, share / max(1e-9, (y[rest] == 1).mean()), (1 - share) / max(1e-9, (y[rest] == 0).mean()))
    return Model(w, bias, *_logistic(margin[rest], y[rest], weight[rest]))


def _scored(model: Model, name: str):
    def run(it):
        mask = np.zeros(BUCKETS, np.uint8)
        for batch in it:
            score = [model.score(features(t.as_py() or "", mask)) for t in batch.column("text")]
            yield pa.record_batch([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores (a former one of that name gives way). Null text: as empty, whose score is the bias's."""
    docs = docs.drop(name)
    return docs.mapInArrow(_scored(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score threshold at least, with their own columns."""
    name = "_score"
    while name in docs.columns:
        name = "_" + name
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= threshold).select(*docs.columns)


def op4_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
