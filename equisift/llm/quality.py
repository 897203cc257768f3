"""Quality by compression: zstandard dictionaries built from good and bad texts; a text that the bad dictionary serves better is likely bad.

A text is compressed whole, in blocks (else a long text would be its own dictionary), once with each dictionary. The difference of the
two sizes over the text's bytes is calibrated to a probability by logistic regression on labelled texts that built no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import calibrate, id_crc32, in_arrow, labelled_sample, utf8

#: Block and dictionary size were chosen by settings.py, on inner folds of the rows that may teach (sf0.1).
BLOCK, LEVEL, DICT_BYTES = 512, 3, 524_288
#: The bound on what is learned from: rows of each class, and bytes of text in all.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 48 << 20


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    block: int = BLOCK

    def scorer(self):
        """A function from a text's bytes to its feature."""
        pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        return lambda text: _difference(pair, text, self.block)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(level=LEVEL)
    return d


def _difference(pair: list, text: bytes, size: int) -> float:
    """Bytes that the good dictionary saves against the bad one, for each byte of text; 0 for an empty text."""
    if not text:
        return 0.0
    good, bad = pair
    n = 0
    for i in range(0, len(text), size):
        block = text[i : i + size]
        n += len(bad.compress(block)) - len(good.compress(block))
    return n / len(text)


def _build(texts: list[bytes], size: int, dict_bytes: int) -> bytes:
    blocks = [t[i : i + size] for t in texts for i in range(0, len(t), size)]
    try:
        return zstandard.train_dictionary(dict_bytes, blocks, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their bytes are the dictionary
        return b"".join(blocks)[-dict_bytes:] or b" " * 8


def fit(sample: list[tuple[str, int]], share: float | None = None, block: int = BLOCK, dict_bytes: int = DICT_BYTES) -> CompressionModel:
    """sample: (text, 1 for good or 0 for bad). Every other text of a class builds its dictionary, the rest calibrate.
    share: of good texts among all labelled ones; the sample's own share if not given. block, dict_bytes: chosen by settings.py.

    With fewer than 8 texts of a class nothing can be learned: the score is then the share of good texts.
    """
    by = {y: [t.encode() for t, label in sample if label == y and t] for y in (0, 1)}
    if share is None:
        share = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
    if min(map(len, by.values())) < 8:
        return CompressionModel(b" " * 8, b" " * 8, 0.0, float(np.log(share / (1 - share))))
    model = CompressionModel(*(_build(by[y][::2], block, dict_bytes) for y in (1, 0)), 0.0, 0.0, block)
    of = model.scorer()
    x = np.array([of(t) for y in (0, 1) for t in by[y][1::2]])
    y = np.array([float(label) for label in (0, 1) for _ in by[label][1::2]])
    return CompressionModel(model.good, model.bad, *calibrate(x, y, share), block)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, budget: int = SAMPLE_BYTES) -> CompressionModel:
    """Learns from labelled rows outside the held-out fold (crc32 of the id mod 3 is 1), at most `rows` of each class."""
    keep = id_crc32("doc_id") % 3 != 1
    n, good = labels.filter(keep).agg(F.count_if(F.col("quality").isin(0, 1)), F.count_if(F.col("quality") == 1)).first()
    return fit(labelled_sample(docs, labels, "quality", keep, rows, budget, 6), (good + 1) / (n + 2))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null and empty texts get the score of no evidence. An empty table gives no rows."""
    return with_score(docs.select(id_col, text_col), model, text_col, drop_text=True)


def with_score(docs: DataFrame, model: CompressionModel, text_col: str = "text", out_col: str = "score", drop_text: bool = False) -> DataFrame:
    """Every row of docs and its score; a column named like out_col is replaced."""
    rows = docs.drop(out_col)
    rest = [c for c in rows.columns if c != text_col or not drop_text]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest) + f", `{out_col}` double"

    def run(batches):
        of = model.scorer()
        for batch in batches:
            x = np.array([of(t or b"") for t in utf8(batch.column(text_col))], float)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(model.probability(x))], [*rest, out_col])

    return rows.transform(in_arrow, run, schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (id_crc32("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
