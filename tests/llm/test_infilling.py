import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from equisift.llm import infilling as m

from .conftest import SCHEMA, Words, rows_of

NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def plain(rows, fim=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    """By whole lists of lines."""
    out = []
    for d, text, *_ in rows:
        text = text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
        h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(lines) + 1) for x in h[:2])
        p, mid, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        if text == "" or any(k in text for k in marks) or h[2] % 100 >= fim:
            out.append((d, len(lines), "plain", None, None, text))
        elif h[3] % 100 < spm:
            out.append((d, len(lines), "spm", len(p), len(mid), marks[1] + s + marks[0] + p + marks[2] + mid))
        else:
            out.append((d, len(lines), "psm", len(p), len(mid), marks[0] + p + marks[1] + s + marks[2] + mid))
    return sorted(out, key=repr)


def test_odd_rows(odd, clashing):
    rows = [tuple(r) for r in odd.collect()]
    assert rows_of(m.infill(odd), *NAMES) == plain(rows)
    assert rows_of(m.infill(clashing), *NAMES) == plain(rows)
    made = clashing.withColumns({"made": F.lit(1), "output": F.lit("o"), "form": F.lit("f"), "prefix_chars": F.lit(2)})
    assert rows_of(m.infill(made), *NAMES) == plain(rows)


def test_shares_marks_and_other_ids(spark):
    w = Words(1)
    texts = [w.text(w.rng.randint(1, 300)) for _ in range(60)] + ["a<P>b\nc", "x\n<S>", "<M>", "<", "<P", "P>\n<", "\n", "\n\n\nx", "\r\n😀\r\n漢"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for fim, spm, seed in ((100, 50, 7), (60, 0, 1), (0, 50, 2), (100, 100, 3)):
        assert rows_of(m.infill(df, fim_percent=fim, spm_percent=spm, seed=seed), *NAMES) == plain(rows, fim, spm, seed)
    named = df.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    assert rows_of(m.infill(named), *NAMES) == plain([(f"id-{i}", *r) for i, *r in rows])
    forms = Counter(r["form"] for r in m.infill(df).collect())
    assert forms["psm"] > 10 and forms["spm"] > 10


def test_texts_come_back(odd):
    got = m.infill(odd).select("doc_id", m.restored("output", "form").alias("text"))
    assert rows_of(got, "doc_id", "text") == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=repr)
    both = odd.select("doc_id", "text", m.digested(m.infilled("doc_id", "text")).alias("d")).select("doc_id", "text", "d.*").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r["restored_sha256"] == sha(r["text"] or "") for r in both)
    assert sorted((r["output_sha256"] for r in both)) == sorted(sha(x[5]) for x in plain([tuple(r) for r in odd.collect()]))


def test_words_as_units(spark):
    rows = [(i, "one two  three\nfour ", None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = m.infill(df, unit=r"\S+\s*").collect()
    assert {r["n"] for r in got} == {4} and len({(r["prefix_chars"], r["middle_chars"]) for r in got}) > 5
    assert all(r["prefix_chars"] in (0, 4, 9, 15, 20) for r in got)
    back = m.infill(df, unit=r"\S+").select(m.restored("output", "form").alias("t")).distinct().collect()  # blanks behind the last unit are the suffix's
    assert [r["t"] for r in back] == ["one two  three\nfour "]


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<S>", "<M><")])
def test_marks_that_texts_could_blur(odd, marks):
    with pytest.raises(ValueError):
        m.infill(odd, marks=marks)


def test_no_rows_and_partitions(empty, odd):
    assert m.infill(empty).collect() == []
    assert rows_of(m.infill(odd.repartition(5)), *NAMES) == rows_of(m.infill(odd.coalesce(1)), *NAMES)
