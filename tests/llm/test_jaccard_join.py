import random

import numpy as np
import pytest

from equisift.llm import jaccard_join
from equisift.llm.common import WordHashes, connected, shingles
from equisift.llm.jaccard_join import jaccard_components, prefix

from .conftest import SCHEMA, Words, rows_of


def brute(rows, k=5, percent=75):
    """(id, n_shingles, component_id) by comparing all pairs; words by hand, not by the operator's code."""
    sets = []
    for _, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=repr)


def near_rows(seed, families=12, size=8):
    w = Words(seed)
    rows, i = [], 0
    for f in range(families):
        base = w.text(w.rng.randint(4, 150))
        for _ in range(w.rng.randint(1, size)):
            rows.append((i, w.near(base, w.rng.randint(0, 12)), "en", "s", 0))
            i += 1
    passage = w.text(50)
    rows += [(i + j, w.text(w.rng.randint(5, 90)) + "\n" + passage, "en", "s", 0) for j in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = near_rows(seed)
    got = rows_of(jaccard_components(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)


@pytest.mark.parametrize("large,rows", [(1, 40), (0, 1 << 16)])
def test_large_groups_are_opened_in_blocks(spark, monkeypatch, large, rows):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", rows)
    monkeypatch.setattr(jaccard_join, "BLOCK_LEAST", min(rows, 1 << 10))
    docs = near_rows(3, 10, 14)
    assert rows_of(jaccard_components(spark.createDataFrame(docs, SCHEMA)), "doc_id", "n_shingles", "component_id") == brute(docs)


def test_chains_and_a_low_threshold(spark):
    w = Words(9)
    rows, text = [], w.text(60)
    for i in range(25):
        rows.append((100 - i, text, "en", "s", 0))
        text = w.near(text, 1)
    rows += near_rows(5, 4, 4)[:10]
    got = rows_of(jaccard_components(spark.createDataFrame(rows, SCHEMA), k=3, percent=60), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows, 3, 60)


def test_odd_rows(odd, clashing):
    want = brute([tuple(r) for r in odd.collect()])
    assert rows_of(jaccard_components(odd), "doc_id", "n_shingles", "component_id") == want
    assert rows_of(jaccard_components(clashing), "doc_id", "n_shingles", "component_id") == want


def test_no_rows(empty):
    assert jaccard_components(empty).collect() == []


def test_a_family_is_not_paired(spark, monkeypatch):
    """Near copies meet in blocks, and their number of comparisons is linear."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    w = Words(4)
    base = w.text(200)
    rows = [(i, w.near(base, 3), "en", "s", 0) for i in range(120)]
    seen = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *a: seen.append(pairs.count()) or verify(pairs, *a))
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert sum(seen) < 4 * 120


def test_prefixes_of_linked_sets_meet():
    rng, words = random.Random(3), WordHashes()
    levels = np.array([rng.choice((0, 0, 1, 5)) for _ in range(1 << jaccard_join.SKETCH_BITS)], np.uint8)
    for _ in range(200):
        a = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        b = [x if rng.random() > 0.03 else "new" for x in a]
        x, y = (shingles(" ".join(t).encode(), words, 3) for t in (a, b))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            assert len(np.intersect1d(prefix(x, levels, 75)[0], prefix(y, levels, 75)[0]))


def test_needed_is_a_lower_bound(spark):
    """The SQL bound never exceeds the shared prefix tokens of linked sets."""
    rng, words = random.Random(5), WordHashes()
    levels = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
    cases = []
    for _ in range(300):
        a = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(3, 80))]
        b = a[rng.randint(0, len(a) // 8) :] + [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 6))]
        x, y = (shingles(" ".join(t).encode(), words, 2) for t in (a, b))
        common = len(np.intersect1d(x, y))
        if len(x) and len(y) and 100 * common >= 75 * (len(x) + len(y) - common):
            cases.append((len(x), len(y), len(np.intersect1d(prefix(x, levels, 75)[0], prefix(y, levels, 75)[0]))))
    assert len(cases) > 50
    df = spark.createDataFrame(cases, "na int, nb int, c int")
    assert df.filter(f"c < {jaccard_join._needed('na', 'nb', 75)}").count() == 0


@pytest.mark.parametrize("percent", [50, 60, 75, 90])
def test_the_bound_of_a_group_is_the_least_of_its_sizes(spark, percent):
    def needed(a, b):
        return (percent * (a + b) + 99 + percent) // (100 + percent) - max((percent * a + 99) // 100, (percent * b + 99) // 100) + 1

    cases = []
    for n in [*range(1, 41), 100, 101, 997]:
        sizes = range((percent * n + 99) // 100, 100 * n // percent + 1)
        for low in {sizes[0] - 3, *sizes[:: max(1, len(sizes) // 12)], n}:
            for high in {*sizes[:: max(1, len(sizes) // 12)], n, sizes[-1], sizes[-1] + 5}:
                if low <= high:
                    cases.append((n, low, high, min(needed(n, m) for m in sizes if low <= m <= high)))
    df = spark.createDataFrame(cases, "n int, low int, high int, least int")
    assert df.filter(f"{jaccard_join._least_needed('n', 'low', 'high', percent)} <> least").collect() == []


def test_a_group_whose_inner_size_needs_less_is_opened(spark):
    """A (10 shingles) links only with B (11), which is in a group with C (12) and D (10); A and B share one prefix token, sizes 10 and 12 need two."""
    words = WordHashes()
    rows = []
    for f in range(12):
        own = sorted((f"w{f}x{i}" for i in range(13)), key=lambda w: int(shingles(w.encode(), words, 1)[0]))
        a, p, q, x, *s = own
        for text in ([a, *s], [p, q, *s], [p, q, x, *s], [p, q, *s[:8]]):
            rows.append((len(rows), " ".join(text), "en", "s", 0))
    got = rows_of(jaccard_components(spark.createDataFrame(rows, SCHEMA), k=1), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows, 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)]
    nodes = sorted({x for e in edges for x in e} | {5000})
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    got = connected(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"), "test")
    assert {r["node"]: r["label"] for r in got.collect()} == {n: find(n) for n in nodes}
