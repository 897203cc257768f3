import zlib
from collections import Counter, defaultdict

import pytest

from equisift.llm import sharding as m

from .conftest import SCHEMA, Words, rows_of


def check(rows, got, n):
    want = sorted(((d, s, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, s, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(n))
    counts = [len(slots[k]) for k in range(n)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # Every shard matches the mixture: a source's count in a shard is its share, give or take two.
    share = Counter(r["source"] for r in got)
    for k in range(n):
        own = Counter(r["source"] for r in got if r["shard"] == k)
        assert all(abs(own[s] - c * counts[k] / len(got)) <= 2 for s, c in share.items())


@pytest.mark.parametrize("bucket", [16, 2048])
def test_laws(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET_ROWS", bucket)
    w = Words(1)
    rows = [(i, w.text(5) if i % 3 else "same", "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(1000)]
    got = m.proportional_shards(spark.createDataFrame(rows, SCHEMA), 24).collect()
    check(rows, got, 24)


def brute(rows, n, seed_order):
    """Places by sorting everything at once; seed_order gives each row's place in the seeded order."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    out = []
    for s, own in by.items():
        own.sort(key=seed_order)
        out += [((2 * i + 1) / (2.0 * len(own)), s, r) for i, r in enumerate(own)]
    out.sort(key=lambda x: (x[0], x[1]))
    return {r[0]: i * n // len(out) for i, (*_, r) in enumerate(out)}


def test_equals_one_big_sort(spark, monkeypatch):
    import hashlib
    import zlib

    monkeypatch.setattr(m, "BUCKET_ROWS", 10)
    rows = [(i, f"t{i}", "en", f"s{i % 4 if i % 5 else 9}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    h = {r[0]: hashlib.md5(f"7:{r[0]}:{zlib.crc32(r[1].encode())}:{len(r[1]) + 8}".encode()).hexdigest()[:13] for r in rows}
    want = brute([(r[0], r[3]) for r in rows], 6, lambda r: h[r[0]])
    assert {r["doc_id"]: r["shard"] for r in m.proportional_shards(df, 6).collect()} == want


@pytest.mark.parametrize("copies", [7, 1 << 16])
def test_very_many_equal_rows(spark, monkeypatch, copies):
    """Rows with null id and no text beside others, of one source and of several: laws hold, and no bucket numbers more than its distinct rows."""
    monkeypatch.setattr(m, "BUCKET_ROWS", 16)
    monkeypatch.setattr(m, "COPIES", copies)
    rows = [(None, None, "en", "hot", 0)] * 3000 + [(None, None, "en", None, 0)] * 500 + [(i, f"t{i}", "en", "hot" if i % 2 else None, 0) for i in range(500)] + [(7, "same", "en", "s", 0)] * 40
    got = m.proportional_shards(spark.createDataFrame(rows, SCHEMA), 24).collect()
    check(rows, got, 24)
    assert len({r["frac"] for r in got if r["source"] == "hot"}) == 3250


def test_odd_rows(odd, clashing):
    rows = [tuple(r) for r in odd.collect()]
    check(rows, m.proportional_shards(odd, 5).collect(), 5)
    clash = clashing.drop("source").withColumn("source", clashing.lang)
    assert m.proportional_shards(clash, 3).count() == len(rows)


def test_no_rows(empty, odd):
    assert m.proportional_shards(empty, 24).collect() == []
    assert Counter(r["shard"] for r in m.proportional_shards(odd.limit(2), 24).collect()).total() == 2
    with pytest.raises(ValueError):
        m.proportional_shards(odd, 0)


def test_files(spark, tmp_path):
    w = Words(2)
    rows = [(i, w.text(5), "en", f"s{i % 3}", 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    m.write_shards(df, m.proportional_shards(df, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(back, "doc_id", "text") == sorted(((r[0], r[1]) for r in rows), key=repr) and back.select("shard").distinct().count() == 4
