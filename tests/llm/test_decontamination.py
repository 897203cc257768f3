import random

from equisift.llm import decontamination as m

from .conftest import SCHEMA, Words, rows_of


def distance(pattern, text):
    """Least edit distance of pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + "".join(c for c in p if rng.random() > 0.1) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        want = distance(p, t)
        got = m.myers_end(p, t, want)
        if want < len(p):
            assert got and got[0] == want
        assert m.myers_end(p, t, want - 1) is None


def case(seed):
    w = Words(seed)
    items = [(i, w.text(w.rng.randint(3, 40), 99)) for i in range(25)]
    docs = []
    for i in range(80):
        text = w.text(w.rng.randint(0, 60))
        if i % 2:
            _, t = w.rng.choice(items)
            t = list(t.upper() if i % 3 else t)
            for _ in range(w.rng.randint(0, max(1, len(t) // 12))):
                k = w.rng.randrange(len(t))
                t[k] = w.rng.choice(["", "z", t[k] + "q"])
            text = text + " " + "".join(t) + "! " + w.text(5)
        docs.append((i, text, None, None, None))
    return docs, items


def brute(docs, items):
    norm = [(i, m.normalise(t)) for i, t in items]
    return [(d, sorted(i for i, p in norm if p and distance(f" {p} ", f" {m.normalise(t)} ") <= len(p) // m.CHARS_PER_EDIT)) for d, t, *_ in docs]


def test_equals_brute_force(spark):
    docs, items = case(3)
    want = brute(docs, items)
    assert sum(bool(x) for _, x in want) > 10
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(m.by_document(m.decontaminate(df, bench)), "doc_id", "items") == sorted(want, key=repr)
    assert rows_of(m.drop_contaminated(df, bench), "doc_id") == sorted(((d,) for d, x in want if not x), key=repr)


def test_small_slices_rows_and_filter(spark, monkeypatch):
    """Texts longer than a slice, many rows of items for a text, a filter so full that most windows pass, no broadcast."""
    for name, value in (("SLICE", 64), ("ITEMS_PER_ROW", 2), ("FILTER_BITS", 10), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(m, name, value)
    docs, items = case(4)
    docs, items = docs[:30], items[:8]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(m.by_document(m.decontaminate(df, bench)), "doc_id", "items") == sorted(brute(docs, items), key=repr)
    assert rows_of(m.drop_contaminated(df, bench), "doc_id") == sorted(((d,) for d, x in brute(docs, items) if not x), key=repr)


def templated(seed, items, texts, own=60):
    """Items that share a sentence; texts that hold it, every fourth with a whole item, slightly changed."""
    w = Words(seed)
    head = "read the passage below with care and choose the best answer to the question that follows it"
    bench = [(i, f"{head}: {w.text(own // 6 + 2, 99)[:own]}") for i in range(items)]
    docs = []
    for i in range(texts):
        item = bench[i % items][1].replace("best", "bst") if i % 4 == 0 else head
        docs.append((i, f"{w.text(20)} {item} {w.text(20)}", None, None, None))
    return docs, bench


def test_templates_equal_brute_force(spark):
    """With room for all pieces beside the template, and without."""
    for own in (90, 24):
        docs, items = templated(7, 12, 24, own)
        df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert sum(bool(x) for _, x in want) >= 6
        assert rows_of(m.by_document(m.decontaminate(df, bench)), "doc_id", "items") == sorted(want, key=repr)


def test_templates_place_few_items(spark):
    """A text that holds the template alone meets no item; before, it met them all."""
    docs, items = templated(8, 400, 400, 120)
    norm = {i: f" {m.normalise(t)} " for i, t in items}
    _, found = m._items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", m.CHARS_PER_EDIT)
    most = max(r["n"] for r in found.groupBy("key").agg(m.F.countDistinct("ik").alias("n")).collect())
    assert most < 40
    per_item = {r["ik"]: r["n"] for r in found.groupBy("ik").agg(m.F.count("*").alias("n")).collect()}
    assert sorted(per_item.values()) == sorted(m.budget(t.strip()) + 1 for t in norm.values())


def test_rare_pieces_are_disjoint_and_enough():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 300)))
        edits = len(item) // 16
        counts = np.array([rng.choice((1, 1, 2, 50)) if rng.random() < 0.3 else rng.choice((1, 90)) for _ in range(max(0, len(item) - m.GRAM + 1))], np.int64)
        got = m.rare_pieces(item, edits, counts)
        assert len(got) == edits + 1 and all(item.startswith(x, a) and x for a, x in got)
        assert all(a + len(x) <= b for (a, x), (b, _) in zip(got, got[1:]))


def test_missing_parts_never_hide_a_match():
    rng = random.Random(6)
    for _ in range(500):
        p = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 80)))
        t = list(p)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        t = "".join(t)
        d = distance(p, t)
        assert not m._hopeless(p, t, d)


def test_words_are_whole_and_ids_of_any_type(spark):
    docs = [("a", "Other words, breathe"), ("b", "over THE hill"), ("c", "the"), ("d", None), ("b", "again (the) end"), (None, "clothe the")]
    df, bench = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("i", "the"), ("j", "hill!"), ("i", "THE")], "item_id string, text string")
    got = rows_of(m.by_document(m.decontaminate(df, bench)), "doc_id", "items", "n_spans")
    assert got == sorted([("a", [], 0), ("b", ["i", "j"], 3), ("c", ["i"], 2), ("d", [], 0), ("b", ["i"], 2), (None, ["i"], 2)], key=repr)
    found = {r["doc_id"]: r["spans"] for r in m.decontaminate(df.filter("text like 'over%'"), bench).collect()}
    assert [(x["item"], x["start"], x["end"], x["distance"]) for x in found["b"]] == [("i", 5, 8, 0), ("i", 5, 8, 0), ("j", 9, 13, 0)]


def test_odd_rows(spark, odd, clashing):
    bench = spark.createDataFrame([(1, "null id"), (2, None), (3, ""), (4, "..!"), (5, "one two three"), (None, "x y"), (5, "one two three")], "item_id long, text string")
    rows = rows_of(m.by_document(m.decontaminate(odd, bench)), "doc_id", "items")
    got = dict(rows)
    assert len(rows) == odd.count() and (None, [1]) in rows and (None, []) in rows
    assert got[8] == [5] and got[9] == [5] and got[0] == [] and got[13] == [None]
    left = m.drop_contaminated(clashing, bench)
    assert left.columns == clashing.columns and left.count() == odd.count() - 4


def test_no_rows(spark, empty, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert m.by_document(m.decontaminate(odd, bench)).filter("contaminated").count() == 0
    assert m.by_document(m.decontaminate(empty, bench)).count() == 0
