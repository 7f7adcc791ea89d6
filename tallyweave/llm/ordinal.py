"""Cumulative-link ordinal regression on hashed text features, for quality grades and for severity of toxicity.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds, which are kept in order. The features of a whole
text are its distinct words and their stems (the first letters, which inflected forms share), hashed, and hashed marks of how
it is written (shares of kinds of characters, of repeated words and lines). The weights are fitted by accelerated proximal
steps that set most of them to zero, on a bounded sample of labelled documents, `per_grade` of each grade at most (the smallest
hashes of doc_id). A grade weighs as it does in all labels to the power 1 - balance: 0 keeps their shares, 1 makes all alike.

Defined cases: null text is empty; an empty text has the mark of an empty text alone; labels with a null id or grade are left
out, of repeated ones the largest grade counts; a document with a null doc_id is scored like any other; rows that share a
doc_id are scored each; without labels every document gets grade 0's score of a constant model and is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, mapped_rows

#: The bound of the sample that is collected to fit a model: so many documents of each grade.
PER_GRADE = 2500
BITS = 18
#: Lengths of stems.
STEMS = (4, 6)

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "shout": b"!?", "symbol": b"#$%&*@^~=+_", "bar": b"|<>{}[]\\/", "stop": b".,;:", "line": b"\n", "wide": range(128, 256)}


def _marks(text: str, raw: bytes, words: list[str], distinct: set[str]) -> list[str]:
    if not words:
        return ["\x00empty"]
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out = [f"\x00{name}:{int(8 * np.sqrt(counts[list(kind)].sum() / len(raw)))}" for name, kind in _KINDS.items()]
    lines = [x for x in text.split("\n") if x.strip()]
    out.append(f"\x00long:{min(12, int(len(raw) / len(words)))}")
    out.append(f"\x00size:{int(np.log2(len(words)))}")
    out.append(f"\x00distinct:{int(8 * len(distinct) / len(words))}:{int(np.log2(len(words))) // 2}")
    out.append(f"\x00lines:{int(8 * len(set(lines)) / max(1, len(lines)))}")
    return out


def features(text: str) -> np.ndarray:
    """Indexes of a text's features, each once."""
    words = text.lower().split()
    distinct = set(words)
    crc = zlib.crc32
    names = [w.encode("utf-8", "surrogatepass") for w in distinct]
    names += [m.encode() for m in _marks(text, text.encode("utf-8", "surrogatepass"), words, distinct)]
    # punctuation at either end doesn't make another word
    names += [s.encode("utf-8", "surrogatepass") for w in distinct if (s := w.strip(".,;:!?\"'()")) != w and s]
    names += [b"\x01" + x.encode("utf-8", "surrogatepass") for x in {w[:k] for k in STEMS for w in distinct if len(w) > k}]
    return np.unique(np.array([crc(x) for x in names], dtype=np.uint32) & np.uint32((1 << BITS) - 1)).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """weights by feature, thresholds between the grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of each grade, a column each."""
        below = _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])
        return np.diff(np.concatenate((np.zeros((len(below), 1)), below, np.ones((len(below), 1))), axis=1), axis=1)

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())


def fit(samples: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, balance: float = 0.0, penalty: float = 0.02, steps: int = 150) -> OrdinalModel:
    """Fits weights and ordered thresholds on all samples at once; features of a single sample have no weight.

    penalty is on the absolute weights, in units of the noise of a gradient over so many samples.
    """
    names = sorted(set(grades.tolist()))
    model = OrdinalModel(names or [0], np.zeros(1 << BITS), np.zeros(max(0, len(names) - 1)))
    if len(names) < 2:
        return model
    y, n = np.searchsorted(names, grades), len(grades)
    used, flat, times = np.unique(np.concatenate(samples), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in samples])
    often = times[flat] > 1
    flat, row, i = flat[often], row[often], np.arange(n)
    share = weight / np.bincount(y, weights=weight)[y] ** balance
    share = share / share.sum()
    prior = np.cumsum(np.bincount(y, weights=share))[:-1]

    def loss(w: np.ndarray, theta: np.ndarray):
        edges = theta[None, :] - np.bincount(row, weights=w[flat], minlength=n)[:, None]
        cdf = np.concatenate((np.zeros((n, 1)), _sigmoid(edges), np.ones((n, 1))), axis=1)
        p = np.maximum(cdf[i, y + 1] - cdf[i, y], 1e-12)
        return -(np.log(p) * share).sum(), cdf * (1 - cdf), p

    def slopes(slope: np.ndarray, p: np.ndarray):
        high, low = slope[i, y + 1] / p * share, slope[i, y] / p * share
        return np.bincount(flat, weights=(high - low)[row], minlength=len(used)), np.array([low[y == k + 1].sum() - high[y == k].sum() for k in range(len(prior))])

    l1, bound, t = penalty / np.sqrt(n), 1.0, 1.0
    w, theta = np.zeros(len(used)), np.log(prior / (1 - prior))
    ahead, ahead_t = w, theta
    for _ in range(steps):
        value, slope, p = loss(ahead, ahead_t)
        g, g_t = slopes(slope, p)
        while True:  # the step is halved until a parabola over the loss holds
            new = ahead - g / bound
            new = np.sign(new) * np.maximum(np.abs(new) - l1 / bound, 0)
            new_t = np.maximum.accumulate(ahead_t - g_t / bound)
            d, d_t = new - ahead, new_t - ahead_t
            if loss(new, new_t)[0] <= value + g @ d + g_t @ d_t + bound / 2 * (d @ d + d_t @ d_t) + 1e-12:
                break
            bound *= 2
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_t = new + (last - 1) / t * (new - w), np.maximum.accumulate(new_t + (last - 1) / t * (new_t - theta))
        w, theta = new, new_t
    model.weights[used], model.thresholds = w, theta
    return model


#: How the two uses weigh their grades: clean documents are to be kept, toxic ones, which are few, to be found.
SETTINGS = {"quality": {"balance": 0.3, "penalty": 0.01}, "toxic": {"balance": 1.0, "penalty": 0.04}}


def train(docs: DataFrame, labels: DataFrame, grade: str, per_grade: int = PER_GRADE) -> OrdinalModel:
    """A model of labels' column `grade`, fitted as SETTINGS has it. What is collected is bounded by per_grade and the number of grades."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(grade).cast("int")).alias("grade"))
    totals = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    sample = None
    for g in sorted(totals):
        some = rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        sample = some if sample is None else sample.unionByName(some)
    if sample is None:
        return fit([], np.zeros(0, dtype=int), np.zeros(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def read(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "grade": frame["grade"], "found": [features(t) for t in frame["text"]]})

    # of rows that share a doc_id one is taken before they are collected, the same one whatever their order
    found = mapped(texts, read, "doc_id long, grade int, found array<int>").groupBy("doc_id", "grade").agg(F.min("found").alias("found"))
    rows = found.toPandas().sort_values("doc_id")
    grades = rows["grade"].to_numpy()
    counts = rows["grade"].value_counts()
    weight = np.array([totals[g] / counts[g] for g in grades.tolist()])
    return fit([np.asarray(x) for x in rows["found"]], grades, weight, **SETTINGS.get(grade, {}))


def scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected (mean grade), tail (probability of any grade above the lowest), grade (the likeliest)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(frames):
        m = shared.value
        names = np.array(m.grades)
        for frame in frames:
            score = np.array([m.score(features(t)) for t in frame["text"].fillna("")], dtype=float)
            p = m.probabilities(score)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("string").astype("Int64"), "expected": p @ names, "tail": 1 - p[:, 0] if len(names) > 1 else np.ones(len(p)), "grade": names[p.argmax(axis=1)] if len(p) else names[:0]})

    # ids as text: a column of whole numbers and nulls would become floats
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, read, "doc_id long, expected double, tail double, grade int")


def selected(docs: DataFrame, model: OrdinalModel, least_tail: float) -> DataFrame:
    """The rows of docs whose tail probability is `least_tail` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(found):
        m = shared.value
        for rows in found:
            score = np.array([m.score(features(t or "")) for t in rows.column("text").to_pylist()], dtype=float)
            tail = 1 - m.probabilities(score)[:, 0] if len(m.grades) > 1 else np.ones(rows.num_rows)
            yield rows.filter(pa.array(tail >= least_tail))

    return mapped_rows(docs, read, docs.schema)
