import random

import pytest

from equisift.llm import line_dedup as m

from .conftest import SCHEMA, rows_of


def brute(rows, run=3, long=8):
    """text and removed lines by looking up every run in a dictionary."""
    docs = sorted({(d is None, d or 0, t, d) for d, t, *_ in rows if t is not None}, key=lambda x: x[:2])
    order = {}
    per = {}
    for k, (*_, t, d) in enumerate(docs):
        lines = [(i, s) for i, x in enumerate(t.split("\n")) if (s := x.strip(" \t\r\x0b\x0c"))]
        gone = set()
        for a in range(len(lines)):
            for n in ({1} if len(lines[a][1].split()) >= long else set()) | ({run} if a + run <= len(lines) else set()):
                key = tuple(s for _, s in lines[a : a + n])
                if (n, key) in order:
                    gone |= {i for i, _ in lines[a : a + n]}
                else:
                    order[n, key] = k
        per[d, t] = sorted(gone)
    out = []
    for d, t, *_ in rows:
        gone = per.get((d, t), [])
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), 0 if t is None else t.count("\n") + 1, gone))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"l{i}" if i % 3 else f"l{i} " + "w " * 9 + "end" for i in range(14)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 14))), None, None, None) for i in range(60)]
    assert rows_of(m.dedup_lines(spark.createDataFrame(rows, SCHEMA)), "doc_id", "text", "n_lines", "removed") == brute(rows)


def test_other_parameters(spark):
    rows = [(1, "a\nb\nc\nd", None, None, None), (2, "x\na\nb\ny", None, None, None), (3, "b\nc", None, None, None)]
    got = rows_of(m.dedup_lines(spark.createDataFrame(rows, SCHEMA), run_lines=2, long_words=99), "doc_id", "removed")
    assert got == [(1, []), (2, [1, 2]), (3, [0, 1])]


def test_long_runs_are_covered_whole(spark):
    run = [f"line {i}" for i in range(50)]
    rows = [(1, "\n".join(["start", *run]), None, None, None), (2, "\n".join(["other", *run, "end"]), None, None, None)]
    assert rows_of(m.dedup_lines(spark.createDataFrame(rows, SCHEMA)), "doc_id", "removed") == [(1, []), (2, list(range(1, 51)))]


def test_odd_rows(odd, clashing, spark):
    """Rows of one id and several texts are told apart by their text's hash, which the brute force doesn't order by; so ids are made distinct first."""
    rows = [tuple(r) for r in odd.filter("doc_id is not null").collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert rows_of(m.dedup_lines(df), "doc_id", "text", "n_lines", "removed") == want
    assert m.dedup_lines(clashing).count() == odd.count()


def test_no_rows(empty):
    assert m.dedup_lines(empty).collect() == []


def test_every_window_has_a_fingerprint():
    rng = random.Random(1)
    text = "\n".join(rng.choice("abcdef") for _ in range(300)).encode()
    at = {f[1] for f in m.fingerprints(text, 3, 99)}
    assert all(at & {a, a + 1, a + 2} for a in range(298)) and len(at) < 250
