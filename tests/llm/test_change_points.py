import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisift.llm import change_points as m

SCHEMA = "vendor_id long, shipped_at timestamp_ntz, quantity int"
START = datetime(2024, 1, 1)


def cost(values):
    n, s, q = len(values), sum(values), sum(x * x for x in values)
    v = 1 + (n * q - s * s) // (n * n)
    return v, n * math.floor(1000 * math.log(v))


def by_hand(rows, least=14, penalty=40000):
    """Every cut of a prefix as a tuple (sum, segments, starts from the last backwards), the least kept."""
    series = {}
    for v, t, x in rows:
        if t is not None and x is not None:
            day = (t.date() - date(1970, 1, 1)).days
            series.setdefault(v, {}).setdefault(day, 0)
            series[v][day] += x
    out = []
    for v, days in series.items():
        lo, hi = min(days), max(days)
        x = [days.get(d, 0) for d in range(lo, hi + 1)]
        n, best = len(x), {0: (0, 0, ())}
        for j in range(1, n + 1):
            offers = [(best[i][0] + cost(x[i:j])[1] + (penalty if i else 0), best[i][1] + 1, (i, *best[i][2])) for i in best if j - i >= least or (j == n and i == 0)]
            if offers:
                best[j] = min(offers)
        total, count, starts = best[n]
        starts = [*reversed(starts), n]
        for k, (a, b) in enumerate(zip(starts, starts[1:]), 1):
            s, c = cost(x[a:b])
            out.append((v, k, lo + a, b - a, sum(x[a:b]), s, c, count, total))
    return sorted(out, key=repr)


def check(df, rows, **options):
    got = m.change_points(df, "vendor_id", "shipped_at", "quantity", **options)
    assert got.columns == ["vendor_id", "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows, **options)


def levels(rng, vendor, days, noise=3):
    level, out = rng.randint(0, 400), []
    for d in range(days):
        if rng.random() < 0.04:
            level = rng.randint(0, 400)
        out += [(vendor, START + timedelta(days=d, hours=rng.randint(0, 23)), level // 2 + rng.randint(0, noise)) for _ in range(2) if rng.random() < 0.9]
    return out


def test_against_every_cut(spark):
    rng = random.Random(1)
    rows = [r for v, days in enumerate((1, 2, 13, 14, 15, 27, 28, 29, 42, 60, 90, 91, 92, 149, 149, 149)) for r in levels(rng, v, days)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df, rows)
    check(df, rows, penalty=1000)
    check(df, rows, least=1, penalty=500)
    check(df, rows, least=5, penalty=0)


def test_ties(spark):
    """Equal cuts everywhere: constant series, also with no penalty, and two values in turns."""
    rows = [(v, START + timedelta(days=d), x(d)) for v, x in enumerate((lambda d: 5, lambda d: d % 2, lambda d: d % 14 // 7, lambda d: 0)) for d in range(75)]
    df = spark.createDataFrame(rows, SCHEMA)
    for penalty in (0, 1, 40000):
        check(df, rows, penalty=penalty)
        check(df, rows, least=3, penalty=penalty)


def test_odd_rows(spark):
    rows = [(1, START, 3), (1, START, 3), (1, None, 9), (1, START + timedelta(days=40), None), (None, START, 4), (None, START + timedelta(days=30), -7), (2, None, None), (3, datetime(1969, 12, 25), 8), (3, datetime(1970, 1, 9), 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("series", "day", "x", "days", "first", "values", "segment_no", "cost")})
    check(df, rows)
    assert m.change_points(df.limit(0), "vendor_id", "shipped_at", "quantity").collect() == []
    with pytest.raises(ValueError):
        m.change_points(df, "vendor_id", "shipped_at", "quantity", least=0)


def test_tiles_and_stacks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, (7, 200)) * (1 + np.arange(200) // 37 % 3)
    want = [m.Stack(values, 14, 40000).segments(r) for r in range(7)]
    for tile in (7, 300, 5000):
        monkeypatch.setattr(m, "TILE", tile)
        assert [m.Stack(values, 14, 40000).segments(r) for r in range(7)] == want
        assert [m.Stack(values[r : r + 1], 14, 40000).segments(0) for r in range(7)] == want


def test_large_numbers_are_exact(spark):
    """Products beyond a long: Python's integers."""
    rng = random.Random(3)
    kind = SCHEMA.replace("quantity int", "quantity long")
    rows = [(1, START + timedelta(days=d), (1 << 30) * (1 + d // 30) + rng.randint(0, 1 << 20)) for d in range(70)]
    check(spark.createDataFrame(rows, kind), rows)
    rows = [(1, START + timedelta(days=d), (1 << 40) * (d % 2)) for d in range(20)]
    got = m.change_points(spark.createDataFrame(rows, kind), "vendor_id", "shipped_at", "quantity").first()
    assert by_hand(rows)[0][5] > m.LONG == got["spread"] and got["cost"] == by_hand(rows)[0][6]


def test_dates_text_series_and_partitions(spark):
    rng = random.Random(4)
    rows = levels(rng, 1, 80) + levels(rng, 2, 50)
    df = spark.createDataFrame(rows, SCHEMA)
    named = df.select(F.concat(F.lit("v"), "vendor_id").alias("vendor_id"), F.to_date("shipped_at").alias("shipped_at"), "quantity").repartition(7)
    assert sorted(tuple(r) for r in m.change_points(named, "vendor_id", "shipped_at", "quantity").collect()) == [(f"v{v}", *r) for v, *r in by_hand(rows)]
