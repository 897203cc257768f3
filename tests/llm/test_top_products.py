import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisift.llm import top_products as m

SCHEMA = "vec_id long, embedding array<float>"
NONE = float("inf")


def by_hand(rows, k, every=20, scale=64):
    """(query_id, rank, score) and the sets of results: all products, sorted."""
    floors = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            floors.append((n, i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for n, i, q in floors:
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, p)), j is None, j or 0, j) for o, j, p in floors if o != n)
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def check(df, rows, k, every=20):
    got = m.top_products(df, k, f"id % {every} = 0")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows, k, every)


def clusters(seed, n, dim, lengths):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.3
    return [(int(i), [float(np.float32(x)) for x in r * s]) for i, (r, s) in enumerate(zip(v, lengths(rng, n)))]


@pytest.mark.parametrize("blocks", [(4096, 1024, 1024), (32, 8, 16)])
def test_against_all_products(spark, monkeypatch, blocks):
    for name, size in zip(("BLOCK", "QUERY_BLOCK", "SLICE"), blocks):
        monkeypatch.setattr(m, name, size)
    rows = clusters(1, 300, 16, lambda rng, n: rng.exponential(1, n) ** 2)
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, 5)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)
    monkeypatch.setattr(m, "QUERY_BLOCK", 4)
    v = [0.5, -0.25, 1.0]
    rows = [(0, v), (20, v), (40, None), (60, [0.1, None, 0.2]), (80, [0.1, float("nan"), 0.2]), (100, [0.1, NONE, 0.2]), (120, []), (140, [0.0, 0.0, 0.0]), (160, [-1.0, -1.0, -1.0]), (1, v), (1, v), (20, v), (None, v), (2, [0.5]), (3, [-0.01, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "rid", "v", "sq", "x", "block", "group", "least", "score", "rank", "query_id")})
    for k in (1, 3, 20):
        check(df, rows, k)
    assert m.top_products(df.limit(0), 3, "id % 20 = 0").collect() == []
    assert m.top_products(df.filter("vec_id = 1"), 3, "id % 20 = 0").collect() == []
    assert m.top_products(df.filter("vec_id = 160"), 3, "id % 20 = 0").collect() == []  # no other row
    with pytest.raises(ValueError):
        m.top_products(df, 0, "id % 20 = 0")


def test_many_equal_vectors(spark, monkeypatch):
    """Equal lengths and scores over many blocks: ties go to the smaller id."""
    monkeypatch.setattr(m, "BLOCK", 16)
    rows = [(i, [0.25, 0.5] if i % 3 else [0.5, 0.25]) for i in range(150)]
    random.Random(2).shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA), rows, 7)


def test_large_components(spark):
    """Beyond what doubles add exactly, and beyond a long."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-(1 << 40), 1 << 40)) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = sorted(tuple(r) for r in m.top_products(df, 4, "id % 20 = 0", scale=1).collect())
    top = (1 << 63) - 1
    for q in (0, 20):
        scores = sorted((-max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(rows[q][1], p)))), i) for i, p in rows if i != q)
        assert [r for r in got if r[0] == q] == [(q, n, i, -s) for n, (s, i) in enumerate(scores[:4], 1)]


def test_one_cell_prunes_and_stays_exact():
    """With strong directions, few pairs are multiplied out, and results are those of all products."""
    rng = np.random.default_rng(5)
    decay = 0.7 ** np.arange(32)
    p, q = (np.floor(64 * rng.normal(size=(n, 32)) * decay) for n in (3000, 50))
    turn = np.linalg.svd(p.T @ p)[0]
    r, c, s = m.best_products(q, np.arange(50) + 10_000, np.full(50, -np.inf), p, np.arange(3000), np.arange(3000), turn, 10)
    scores = (q @ p.T).astype(int)
    want = [sorted((-x, i) for i, x in enumerate(row))[:10] for row in scores]
    assert [(int(a), int(b), int(x)) for a, b, x in zip(r, c, s)] == [(i, j, -x) for i, row in enumerate(want) for x, j in row]
    floor = np.array([-w[4][0] for w in want], float)  # only scores that reach it are wanted
    r, c, s = m.best_products(q, np.arange(50) + 10_000, floor, p, np.arange(3000), np.arange(3000), turn, 10)
    assert all(x >= floor[i] for i, x in zip(r, s)) and all((r == i).sum() >= 5 for i in range(50))
