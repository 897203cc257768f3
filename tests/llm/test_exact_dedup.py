import hashlib
import re

from equisift.llm import exact_dedup as m

from .conftest import SCHEMA, Words, rows_of

NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = {}
    for i, (d, text, *_) in enumerate(rows):
        raw = text or ""
        groups.setdefault(re.sub("[ \t-\r]", "", raw), []).append((-len(raw), d is None, d or 0, i, d))
    out = []
    for norm, own in groups.items():
        best = min(own)
        out += [(x[4], best[4], len(own), x[3], hashlib.sha256(norm.encode()).hexdigest(), best[3]) for x in own]
    return out


def check(df, rows):
    got, want = rows_of(df, *NAMES), brute(rows)
    assert rows_of(df, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(((d, k, n, s) for d, k, n, _, s, _ in want), key=repr)
    assert sum(r[3] for r in got) == len({s for *_, s, _ in want})  # one row of each group stays, even of repeated rows
    assert all(r[0] == r[1] for r in got if r[3])


def test_odd_rows(odd, clashing):
    rows = [tuple(r) for r in odd.collect()]
    check(m.exact_dedup(odd), rows)
    check(m.exact_dedup(clashing), rows)


def test_text_ids(spark):
    """Ids of any type that has an order: of equal texts of one length the least id stays, nulls last."""
    rows = [("b", "x y", None, None, None), ("a", "xy ", None, None, None), (None, "x y", None, None, None), ("c", "other", None, None, None), ("10", "x y", None, None, None), ("9", " xy", None, None, None)]
    got = m.exact_dedup(spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string")))
    assert rows_of(got, "doc_id", "keep_id", "group_size") == sorted([(r[0], "c" if r[0] == "c" else "10", 1 if r[0] == "c" else 5) for r in rows], key=repr)
    assert got.filter("kept").count() == 2


def test_no_rows(empty):
    assert m.exact_dedup(empty).collect() == []


def test_many_copies(spark):
    w = Words(1)
    texts = [w.text(n) for n in (3, 40, 400, 4000)]
    rows = [(i, texts[i % 4].replace(" ", "  " if i % 3 else " "), None, None, None) for i in range(200)]
    check(m.exact_dedup(spark.createDataFrame(rows, SCHEMA)), rows)


def test_chunks_make_up_the_text_and_follow_content(spark):
    w = Words(2)
    a = w.text(3000).replace(" ", "").replace("\n", "")
    df = spark.createDataFrame([(0, a), (1, "inserted" + a), (2, "y" * 5000), (3, "")], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", m.chunks(df.t).alias("c")).collect()}
    assert "".join(got[0]) == a and "".join(got[2]) == "y" * 5000 and got[3] == []
    assert len(set(got[0]) & set(got[1])) > 0.8 * len(got[0])  # cuts come back in step
    assert all(len(c) <= m.MOST + 1 for c in got[0])


def test_clashing_identifiers_fall_back_to_the_digest(odd, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "identifier", lambda c: F.struct(F.lit(1).cast("bigint").alias("d1"), F.lit(2).cast("bigint").alias("d2")))
    check(m.exact_dedup(odd), [tuple(r) for r in odd.collect()])
