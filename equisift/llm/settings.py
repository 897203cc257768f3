"""Choosing the settings of the two classifiers on inner folds of the rows that may teach; the held-out folds play no part.

    python -m equisift.llm.settings documents.parquet labels.parquet

The sample is dealt into FOLDS folds by a checksum of the text, so that equal texts share a fold. Each setting learns from all folds but one and is judged on that one,
by the mean of the two classes' error rates at 0.5, over all folds; of settings with equal errors the one with fewer errors in all, then the first of the grid is chosen.
"""

from __future__ import annotations

import itertools
import os
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor
from functools import partial

import numpy as np

from . import quality, toxicity
from .common import WordHashes

FOLDS = 4

QUALITY_GRID = [dict(zip(("block", "dict_bytes"), v)) for v in itertools.product((256, 512, 1024, 2048), (65_536, 131_072, 262_144, 524_288))]
TOXICITY_GRID = [dict(zip(("alpha", "l1", "least", "share"), v)) for v in itertools.product((0.3, 1.0, 3.0), (10.0, 20.0, 40.0, 80.0), (2, 4), (0.15, 0.2, 0.3, 0.4))]


def quality_errors(train: list, test: list, setting: dict) -> tuple[int, int]:
    """Errors on texts of class 0 and 1."""
    model = quality.fit(train, **setting)
    of = model.scorer()
    guess = model.probability(np.array([of(t.encode()) for t, _ in test], float)) >= 0.5
    return _errors(guess, test)


def toxicity_errors(train: list, test: list, setting: dict) -> tuple[int, int]:
    model, words = toxicity.fit(train, **setting), WordHashes()
    weights = model.dense()
    return _errors(np.array([weights[toxicity.features(t.encode(), words)].sum() for t, _ in test], float) + model.bias >= 0, test)


def _errors(guess: np.ndarray, test: list) -> tuple[int, int]:
    y = np.array([v for _, v in test])
    return int((guess & (y == 0)).sum()), int((~guess & (y == 1)).sum())


def _of_fold(errors, sample: list, setting: dict, fold: int) -> tuple[int, int]:
    own = [zlib.crc32(t.encode()) % FOLDS for t, _ in sample]
    return errors([v for v, f in zip(sample, own) if f != fold], [v for v, f in zip(sample, own) if f == fold], setting)


def choose(errors, sample: list[tuple[str, int]], grid: list[dict], workers: int = 1) -> tuple[dict, list]:
    """The chosen setting, and (setting, errors on class 0, errors on class 1) of all, in the grid's order."""
    jobs = [(s, f) for s in grid for f in range(FOLDS)]
    run = partial(_of_fold, errors, sample)
    if workers > 1:
        with ProcessPoolExecutor(workers) as pool:
            got = list(pool.map(run, *zip(*jobs)))
    else:
        got = [run(s, f) for s, f in jobs]
    totals = [(s, *map(sum, zip(*got[i * FOLDS : (i + 1) * FOLDS]))) for i, s in enumerate(grid)]
    n1 = sum(y for _, y in sample)
    n0 = len(sample) - n1
    return min(totals, key=lambda r: (r[1] / max(n0, 1) + r[2] / max(n1, 1), r[1] + r[2]))[0], totals


def main(documents: str, labels: str) -> None:
    import pandas as pd

    rows = pd.read_parquet(documents, columns=["doc_id", "text"]).merge(pd.read_parquet(labels), on="doc_id")
    fold = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()))
    for label, keep, errors, grid in (("quality", fold % 3 != 1, quality_errors, QUALITY_GRID), ("toxic", fold % 5 != 0, toxicity_errors, TOXICITY_GRID)):
        own = rows[keep & rows[label].isin([0, 1])]
        sample = [(t or "", int(y)) for t, y in zip(own["text"], own[label])]
        best, totals = choose(errors, sample, grid, os.cpu_count() or 1)
        print(label, len(sample), "texts,", sum(y for _, y in sample), "of class 1")
        for s, e0, e1 in totals:
            print("*" if s == best else " ", s, "errors", e0, e1)


if __name__ == "__main__":
    main(*sys.argv[1:3])
