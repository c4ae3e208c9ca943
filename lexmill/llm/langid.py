"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (byte n-grams of the lower-cased text,
white space counting as word boundary); a linear softmax over the mean gives the language. Both are
trained together by stochastic gradient descent in numpy on a bounded sample. As the mean and the
softmax's input are linear, scoring needs one logit row per subword only: texts of any length are
scored whole, in one pass. The softmax's temperature and the rejection threshold are set on sample
rows that training didn't see.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; an empty
table, or one without labels to learn from, makes every text `und`; ties go to the language that
sorts first; repeated rows are scored alike; null ids and extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, batches, bounded_sample, held_out, mix, text_chunks

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
DIM = 16
PER_LANG = 1500  # rows of the sample for each language
SHORTEST = 20  # characters of the shortest crops that training uses
EPOCHS = 4
RATE = 0.5
REJECTED = 0.001  # share of right calibration rows that the threshold may reject
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_SEEDS = mix(np.arange(100, 108, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def subwords(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (len(data) - size + 1 of them)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.int32)
    h = np.zeros(n, np.uint32)
    for k in range(size):
        h *= np.uint32(0x01000193)
        h ^= data[k : k + n]
    h *= _SEEDS[size]
    return (h >> np.uint32(17)).astype(np.int32)


_FOLD = _LOWER.astype(np.uint32)
_FOLD[_SPACE] = 32


def fold(raw: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(raw, np.uint8)]


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw_scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)), np.float64)
        for first, end, part in text_chunks(texts, 1 << 20):
            data = fold(b" " + b" ".join(part) + b" ")
            lens = np.fromiter(map(len, part), np.int64, len(part))
            start = np.cumsum(lens + 1) - lens - 1  # at the space before each text
            total = np.zeros((len(part), len(self.langs)))
            count = np.zeros(len(part))
            for size in SIZES:
                # Only n-grams within a text and its two spaces: neighbours in a batch don't matter.
                at = subwords(data, size)
                n = np.maximum(lens + 3 - size, 0)
                bounds = np.minimum(np.stack([start, start + n], axis=1).ravel(), len(at))
                for k in range(len(self.langs)):
                    values = np.append(self.logits[:, k][at].astype(np.float64), 0.0)
                    total[:, k] += np.where(n > 0, np.add.reduceat(values, bounds)[::2], 0.0)
                count += n
            out[first:end] = total / np.maximum(count, 1)[:, None] + self.bias
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.raw_scores(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = fold(b" " + text.encode("utf-8", "surrogatepass") + b" ")
    found = np.bincount(np.concatenate([subwords(data, s) for s in SIZES]), minlength=BUCKETS)
    at = np.flatnonzero(found)
    return at, (found[at] / found.sum()).astype(np.float32)


def train(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    """SGD over the texts: in the first epoch whole, then crops of any length, at any place, so that
    short texts are met too."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = max(1, len(texts) // 5) if len(texts) >= 10 else 0
    calibration, learning = order[:cut], order[cut:]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, step = EPOCHS * len(learning), 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(learning):
            text = texts[i]
            if epoch and len(text) > SHORTEST:
                long = int(np.exp(rng.uniform(np.log(SHORTEST), np.log(len(text)))))
                s = int(rng.integers(0, len(text) - long + 1))
                text = text[s : s + long]
            at, c = _features(text)
            rate = RATE * (1 - step / steps)
            step += 1
            h = c @ emb[at]
            err = softmax((h @ w + bias).astype(np.float64)).astype(np.float32)
            err[y[i]] -= 1
            back = w @ err
            w -= rate * np.outer(h, err)
            bias -= rate * 0.1 * err
            emb[at] -= (rate * len(SIZES) * 4) * np.outer(c, back)
    model = LanguageModel(names, (emb @ w).astype(np.float32), bias.astype(np.float64))
    if cut:
        _calibrate(model, [texts[i] for i in calibration], y[calibration])
    return model


def _calibrate(model: LanguageModel, texts: list[str], y: np.ndarray) -> None:
    z = model.raw_scores(texts)
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    even = 1.0 / len(model.langs)
    model.threshold = float(min(np.quantile(right, REJECTED), even + 0.5 * (1 - even))) if len(right) else even


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """Learn from non-null text and lang of rows that aren't held out: a hash sample of about
    per_lang rows of each language, with their whole texts."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    got = bounded_sample(rows, "lang", per_lang).select("doc_id", "lang", "text").toPandas()
    got = got.loc[np.array([bool(_LETTER.search(t)) for t in got["text"]], bool)].sort_values(["doc_id", "text"])
    if not len(got):
        return None
    return train(got["text"].tolist(), got["lang"].tolist())


def judge(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, score, rejected) of each text."""
    lettered = np.array([t is not None and bool(_LETTER.search(t)) for t in texts], bool)
    if model is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    p = model.probabilities(texts)
    best = p.argmax(axis=1)
    score = np.where(lettered, p.max(axis=1), 0.0)
    langs = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
    return langs, score, ~lettered | (score < model.threshold)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row a document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            langs, score, rejected = judge(model, pdf["text"].tolist())
            out = pdf[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(lang_pred=langs, score=score, rejected=rejected)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(model: LanguageModel | None) -> Column:
    """A filter over a `text` column: true where the text isn't rejected."""

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series(~judge(model, texts.tolist())[2])

    return keep(F.col("text").cast("string"))
