import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisift.llm import quality, settings, toxicity
from equisift.llm.common import calibrate, labelled_sample

from .conftest import SCHEMA, Words, rows_of

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=240):
    """Good prose, shouted junk, and prose with abuse in it."""
    w = Words(seed)
    docs, labels = [], []
    for i in range(n):
        text = w.text(w.rng.randint(20, 200))
        good, toxic = int(i % 4 != 0), int(i % 5 == 1)
        if not good:
            text = " !! ".join(text.upper().split()) + " $$$ ### " * 5
        if toxic:
            words = text.split(" ")
            for k in range(0, len(words), 9):
                words[k] = w.rng.choice(["vilewort", "scumword", "hateterm"])
            text = " ".join(words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module,label,fold", [(quality, "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1), (toxicity, "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0)])
def test_held_out_accuracy(labelled, module, label, fold):
    docs, labels = labelled
    got = {r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, labels)).collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [i for i in truth if fold(i)]
    assert len(held) > 20 and all(0 <= got[i] <= 1 for i in got)
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.93


@pytest.mark.parametrize("module", [quality, toxicity])
def test_the_held_out_fold_and_other_columns_teach_nothing(labelled, module, spark):
    docs, labels = labelled
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) if module is quality else (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    turned = labels.withColumns({c: F.when(fold, 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c in ("quality", "toxic")})
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    assert rows_of(module.score(docs, module.train(docs, labels)), "doc_id", "score") == rows_of(module.score(docs, module.train(other, turned)), "doc_id", "score")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(labelled, module, odd, clashing, empty, spark):
    docs, labels = labelled
    model = module.train(docs, labels)
    got = rows_of(module.score(odd, model), "doc_id", "score")
    assert len(got) == odd.count() and all(0 <= s <= 1 for _, s in got)
    assert rows_of(module.score(clashing, model), "doc_id", "score") == got
    scores = dict(got)
    assert scores[3] == scores[4]  # empty and null
    assert module.score(empty, model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_nothing_to_learn_from(module, odd, empty, spark):
    none = spark.createDataFrame([], LABELS)
    assert {s for _, s in rows_of(module.score(odd, module.train(odd, none)), "doc_id", "score")} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 1), (0, None, None), (1, 1, 0), (1, 0, 1), (77777, 1, 1)], LABELS)  # unlabelled, contradicting, unknown
    assert module.score(odd, module.train(odd, nulls)).count() == odd.count()
    assert module.score(empty, module.train(empty, none)).count() == 0


def test_other_columns_come_through(labelled, clashing):
    docs, labels = labelled
    out = quality.with_score(clashing, quality.train(docs, labels), out_col="_q")
    assert out.columns == [*clashing.columns, "_q"] and out.count() == clashing.count()


def test_the_sample_is_bounded(labelled):
    docs, labels = labelled
    got = labelled_sample(docs, labels, "quality", F.lit(True), 20, 1 << 30, 1)
    assert sorted(y for _, y in got) == [0] * 20 + [1] * 20
    assert sum(len(t.encode()) for t, _ in labelled_sample(docs, labels, "quality", F.lit(True), 100, 20_000, 1)) <= 20_000


def test_long_texts_are_scored_whole(labelled):
    """Junk at the far end of a long text moves its score."""
    docs, labels = labelled
    of = quality.train(docs, labels).scorer()
    w = Words(5)
    good = w.text(20_000)
    assert of((good + " !! ".join(w.text(20_000).upper().split())).encode()) < of(good.encode())
    model = toxicity.train(docs, labels)
    weights, words = model.dense(), toxicity.WordHashes()
    assert weights[toxicity.features((good + " vilewort scumword hateterm").encode(), words)].sum() > weights[toxicity.features(good.encode(), words)].sum()


def test_quality_scores_equal_two_compressors(labelled):
    """The score by hand: each block compressed with either dictionary, sizes' difference over the text's bytes, logistic."""
    import math

    import zstandard

    docs, labels = labelled
    model = quality.train(docs, labels)
    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for i, s in rows_of(quality.score(docs, model), "doc_id", "score"):
        blocks = [texts[i][k : k + model.block] for k in range(0, len(texts[i]), model.block)]
        x = (sum(len(bad.compress(b)) for b in blocks) - sum(len(good.compress(b)) for b in blocks)) / len(texts[i])
        assert s == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.intercept))), abs=1e-9)


def plain_ftrl(sample, epochs=3, alpha=0.3, beta=1.0, l1=20.0, l2=1.0, least=4, seed=10):
    """FTRL-proximal one coordinate at a time, over dicts; the weights before calibration."""
    import math

    words = toxicity.WordHashes()
    x = [(toxicity.features(t.encode(), words).tolist(), y) for t, y in sample]
    x = [v for i, v in enumerate(x) if i % 8]
    seen, z, n = {}, {}, {}
    for f, _ in x:
        for k in f:
            seen[k] = seen.get(k, 0) + 1
    ones = sum(y for _, y in x)
    zb = nb = 0.0

    def w_of(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[k])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            f, y = x[i]
            f = [k for k in f if seen[k] >= least]
            w = {k: w_of(k) for k in f}
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = len(x) / (2 * (ones if y else len(x) - ones)) * (1 / (1 + math.exp(-(sum(w.values()) + b))) - y)
            for k in f:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[k]
                n[k] = old + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b, nb + g * g
    return {k: w_of(k) for k in z if w_of(k)}


def test_weights_equal_plain_ftrl(labelled):
    """The batched learner against one that takes a coordinate at a time: the same features, and weights in one proportion, the calibration's slope."""
    docs, labels = labelled
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 100, 1 << 30, 10)
    model, plain = toxicity.fit(sample, alpha=0.3, l1=2.0, least=4), plain_ftrl(sample, alpha=0.3, l1=2.0, least=4)
    assert model.places.tolist() == sorted(plain) and len(plain) > 5
    ratio = model.weights / np.array([plain[k] for k in model.places.tolist()])
    assert np.allclose(ratio, ratio[0], rtol=1e-6)


@pytest.mark.parametrize("errors,label,grid", [(settings.quality_errors, 1, [{"block": 512, "dict_bytes": 65_536}, {"block": 1024, "dict_bytes": 65_536}]), (settings.toxicity_errors, 2, [{"l1": 500.0}, {"l1": 2.0}])])
def test_settings_are_chosen_on_inner_folds(errors, label, grid):
    """The choice has the least mean of the classes' error rates, counted by hand over the folds; each text is judged by a model that did not see it or its copies."""
    docs, labels = corpus(seed=3)
    sample = [(d[1], row[label]) for d, row in zip(docs, labels)]
    best, totals = settings.choose(errors, sample + sample[:20], grid)
    assert [t[0] for t in totals] == grid
    seen = []
    for s in grid:
        e = np.zeros(2, int)
        for f in range(settings.FOLDS):
            train, test = ([v for v in sample + sample[:20] if (zlib.crc32(v[0].encode()) % settings.FOLDS == f) == held] for held in (False, True))
            assert not {t for t, _ in train} & {t for t, _ in test}
            e += errors(train, test, s)
        seen.append(tuple(e))
    assert [t[1:] for t in totals] == seen
    n = np.bincount([y for _, y in sample + sample[:20]])
    assert best == min(zip(grid, seen), key=lambda r: r[1][0] / n[0] + r[1][1] / n[1])[0]
    if label == 2:
        assert best == {"l1": 2.0}  # with so much L1 nothing is learned


def test_weights_are_sparse(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert 0 < len(model.places) < 2000


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, intercept = calibrate(x, y, float(y.mean()))
    assert abs(slope - 2) < 0.1 and abs(intercept + 1) < 0.1
    assert all(np.isfinite(calibrate(np.array([0.0, 1.0]), np.array([0.0, 1.0]), 0.5)))


def test_a_very_long_text_does_not_end_the_sample(spark):
    """Each class begins with texts of more than its bytes, whatever the hash order."""
    docs = spark.createDataFrame([(i, "é" * 9_000 if i % 4 < 2 else f"short {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 100, 32_000, 1)
    for y in (0, 1):
        own = [t for t, label in got if label == y]
        assert len(own) >= 30 and sum(len(t.encode()) for t in own) <= 16_000 and any(t.startswith("é") for t in own) and any(t.startswith("short") for t in own)


def test_a_very_long_text_counts_from_end_to_end(spark):
    docs = spark.createDataFrame([(0, "a" * 50_000 + "b" * 50_000 + "c" * 50_000)], "doc_id long, text string")
    (text, _), = labelled_sample(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"), "quality", F.lit(True), 10, 320_000, 1)
    assert 4_800 < len(text) <= 5_000 and text[0] == "a" and text[-1] == "c" and abs(text.count("b") * 3 - len(text)) < len(text) / 4
