"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip a word, hashed to 2**BITS places. Per-coordinate rates and L1 leave few
weights other than 0; those are sent to the scorers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, calibrate, gram_hashes, id_crc32, in_arrow, labelled_sample, mix, utf8

BITS = 20
#: The bound on what is learned from: rows of each class, and bytes of text in all.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20
#: Toxic texts weigh as this share of all in the calibration. Chosen, with fit's alpha, l1 and least, by settings.py, on inner folds of the rows that may teach (sf0.1).
SHARE = 0.4


def features(text: bytes | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct places of a text's features; a word loses marks at its ends and its A-Z are lower-cased."""
    found = [w for x in (text or b"").lower().split() if (w := x.strip(b".,;:!?\"'()[]|*%#$&-"))]
    if not found:
        return np.empty(0, np.int64)
    h = words.of(found)
    with np.errstate(over="ignore"):
        skip = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ mix(h[2:])) if len(h) > 2 else h[:0]
        one = mix(h + np.uint64(1))
    return np.unique((np.concatenate([one, gram_hashes(h, 2), skip]) >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass(frozen=True)
class FtrlModel:
    """Weights other than 0, by place; bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.places] = self.weights
        return w


def fit(sample: list[tuple[str, int]], epochs: int = 3, alpha: float = 3.0, beta: float = 1.0, l1: float = 20.0, l2: float = 1.0, least: int = 2, share: float = SHARE, seed: int = 10) -> FtrlModel:
    """FTRL-proximal, one example at a time in a seeded order; classes weigh alike in the loss. Features that fewer than `least` texts
    have are left out; settings.py chose the settings. Of the weights' sums, a logistic regression on every eighth text, which trained no weight, makes probabilities.

    Without texts of both classes the score is constant: the smoothed share of toxic texts.
    """
    words = WordHashes()
    x = [(features(t.encode(), words), y) for t, y in sample]
    aside, x = x[::8], [v for i, v in enumerate(x) if i % 8]
    n1 = sum(y for _, y in x)
    if not 0 < n1 < len(x):
        own = (sum(y for _, y in x + aside) + 1) / (len(x + aside) + 2)
        return FtrlModel(np.empty(0, np.int64), np.empty(0), float(np.log(own / (1 - own))))
    seen = np.zeros(1 << BITS, np.int64)
    for at, _ in x:
        seen[at] += 1
    x = [(at[seen[at] >= least], y) for at, y in x]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    weight = {1: len(x) / (2 * n1), 0: len(x) / (2 * (len(x) - n1))}
    rng = np.random.default_rng(seed)

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def bias():
        return -zb / ((beta + np.sqrt(nb)) / alpha)

    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, y = x[i]
            w = solve(z[at], n[at])
            b = bias()
            g = weight[y] * (1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y)
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - sb * b
            nb += g * g
    w = solve(z, n)
    at = np.flatnonzero(w)
    slope, intercept = calibrate(np.array([w[f].sum() for f, _ in aside]), np.array([float(y) for _, y in aside]), share)
    return FtrlModel(at, slope * w[at], intercept)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, budget: int = SAMPLE_BYTES) -> FtrlModel:
    """Learns from labelled rows outside the held-out fold (crc32 of the id mod 5 is 0), at most `rows` of each class."""
    return fit(labelled_sample(docs, labels, "toxic", id_crc32("doc_id") % 5 != 0, rows, budget, 10))


def score(docs: DataFrame, model: FtrlModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null and empty texts get the score of the bias alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        weights, words = model.dense(), WordHashes()
        for batch in batches:
            x = np.array([weights[features(t, words)].sum() for t in utf8(batch.column("text"))], float) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(in_arrow, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (id_crc32("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
