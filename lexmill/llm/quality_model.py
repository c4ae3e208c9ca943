"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams (byte n-grams of the text as written, so that symbols,
capitals and layout count, and n-grams of the pattern of repeated words), scaled by class log-count
ratios and set to about unit length; a linear hinge-loss model over them is fitted by dual
coordinate descent, on a bounded sample of labelled rows with their whole texts. A logistic curve,
fitted on sample rows that the model didn't see and weighted by the label shares of all labelled
rows, turns margins into scores.

Defined results: null and empty texts have no n-grams and get the curve's value at the bias alone;
repeated rows are scored alike; a table without both labels gives every text the share of label 1
(0.5 without labels); an empty table gives no rows; null ids count as not held out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_sample, held_out, mix

BITS = 18
SIZES = (2, 3, 4)
PER_LABEL = 3000  # rows of the sample for each label
EPOCHS = 12
COST = 4.0
SMOOTH = 1.0
DAMP = 0.25  # of the sample's median squared length
GOOD = 0.7
_SEEDS = mix(np.arange(200, 208, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_PIECE = 1 << 20


def repeat_shapes(text: str) -> np.ndarray:
    """Buckets of the n-grams of a second spelling of the text: per word, whether it is the word
    before it. Sizes 1 to 4, and whether 1, 2, 4, ... per cent of the words are such."""
    words = text.split()
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, max(0, len(words) - 1)).astype(np.uint32)
    if not same.any():
        return np.empty(0, np.int32)
    codes = []
    for size in range(1, 5):
        if len(same) >= size:
            gram = sum(same[k : len(same) - size + 1 + k] << np.uint32(k) for k in range(size))
            codes.append(np.unique(gram) + np.uint32(1 << size))
    share = 100 * same.mean()
    codes.append(np.arange(64, 64 + 1 + int(np.log2(max(1, share))), dtype=np.uint32))
    return (mix(np.concatenate(codes).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int32)


def indicators(text: str | None, slot: np.ndarray) -> np.ndarray:
    """Distinct buckets of the text's n-grams. slot: scratch space of a bucket's size each."""
    if not text:
        return np.empty(0, np.int32)
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    found = []
    for first in range(0, len(raw), _PIECE):  # very long texts in pieces, to bound memory
        data = raw[first : first + _PIECE + max(SIZES) - 1].astype(np.uint32)
        for size in SIZES:
            n = len(data) - size + 1
            if n <= 0:
                continue
            h = np.full(n, size, np.uint32)
            for k in range(size):
                h *= np.uint32(0x01000193)
                h ^= data[k : k + n]
            h *= _SEEDS[size]
            at = (h >> np.uint32(32 - BITS)).astype(np.int32)
            order = np.arange(n, dtype=np.int32)
            slot[at] = order
            found.append(at[slot[at] == order])
    found.append(repeat_shapes(text))
    at = np.concatenate(found)
    order = np.arange(len(at), dtype=np.int32)
    slot[at] = order
    return at[slot[at] == order]


_MASK_BYTES = (1 << BITS) // 8


def _packed(at: np.ndarray) -> bytes:
    """Buckets as a sorted list or, where that is longer, as one bit for each."""
    if 4 * len(at) < _MASK_BYTES:
        return np.sort(at).astype("<i4").tobytes()
    mask = np.zeros(1 << BITS, bool)
    mask[at] = True
    return np.packbits(mask).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i4") if len(x) < _MASK_BYTES else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))).astype(np.int32)


@dataclass
class QualityModel:
    ratio: np.ndarray  # class log-count ratio of each bucket
    weight: np.ndarray  # hinge-loss weight times ratio
    bias: float
    slope: float
    shift: float
    damp: float  # added to the squared length, so that a text of few n-grams tends to the bias

    def margins(self, texts: list[str | None]) -> np.ndarray:
        slot = np.zeros(1 << BITS, np.int32)
        return self.margins_of(indicators(t, slot) for t in texts)

    def margins_of(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        out = []
        for at in rows:
            r = self.ratio[at]
            norm = float(np.sqrt(np.dot(r, r) + self.damp))
            out.append(self.bias + (float(self.weight[at].sum(dtype=np.float64)) / norm if len(at) else 0.0))
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)
    for at, label in zip(rows, y):
        (p if label > 0 else q)[at] += 1
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """min 1/2 |w|^2 + cost * sum of hinge losses, one dual variable at a time; the last weight is
    the bias (a constant feature)."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(1 << BITS, np.float64), 0.0
    alpha = np.zeros(len(rows))
    q = np.array([float(np.dot(v, v)) + 1 for v in values])
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            g = y[i] * (float(np.dot(w[at], v)) + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost)
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[at] += d * v
                b += d
                largest = max(largest, abs(d))
        if largest < 1e-3:
            break
    return w, b


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for a weighted logistic curve, with Platt's softened targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones_like(m)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - t))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(rows: list[np.ndarray], labels: list[int], share: float, seed: int = 3) -> QualityModel:
    """rows: the indicators of each text."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    order = np.random.default_rng(seed).permutation(len(rows))
    cut = len(rows) // 4
    fold, learning = order[:cut], order[cut:]
    ratio = log_count_ratio([rows[i] for i in learning], y[learning])

    damp = DAMP * float(np.median([np.dot(ratio[rows[i]], ratio[rows[i]]) for i in learning])) + 1e-9

    def unit(at: np.ndarray) -> np.ndarray:
        r = ratio[at]
        return r / np.sqrt(np.dot(r, r) + damp)

    w, b = dual_coordinate_descent([rows[i] for i in learning], [unit(rows[i]) for i in learning], y[learning], COST, EPOCHS, seed)
    model = QualityModel(ratio, (w * ratio).astype(np.float32), b, 1.0, 0.0, damp)
    if cut:
        m = model.margins_of([rows[i] for i in fold])
        good = (y[fold] > 0).mean()
        weight = np.where(y[fold] > 0, share / max(good, 1e-9), (1 - share) / max(1 - good, 1e-9))
        model.slope, model.shift = _logistic(m, y[fold], weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel | float:
    """Learn from labelled rows that aren't held out: a hash sample of about per_label rows of each
    label. The n-grams of their whole texts are found in the tasks; a row sends
    2 ** BITS bits at most. Returns the share of label 1 where there aren't both labels."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return share
    sample = bounded_sample(marks, "quality", per_label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # About 2 * per_label ids: a size that the parameter bounds, so it may be broadcast.
    rows = texts.join(F.broadcast(sample), "doc_id")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = np.zeros(1 << BITS, np.int32)
        for pdf in batches(it):
            found = [_packed(indicators(t, slot)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "found": pd.Series(found, dtype=object)})

    got = rows.select("doc_id", "quality", "text").mapInPandas(run, "doc_id long, quality int, found binary").toPandas()
    got = got.sort_values(["doc_id", "found"])
    if got["quality"].nunique() < 2:
        return share
    return train([_unpacked(x) for x in got["found"]], got["quality"].tolist(), share)


def score(docs: DataFrame, model: QualityModel | float) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            s = np.full(len(pdf), model) if isinstance(model, float) else model.scores(pdf["text"].tolist())
            out = pdf[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(score=s, predicted=(s >= GOOD).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
