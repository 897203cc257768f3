import itertools
import os
import random

import pytest

from equisift.llm import pieces as m

from .conftest import rows_of

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(m.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    return m.Pieces.load(m.MODEL), sentencepiece.SentencePieceProcessor(model_file=m.MODEL)


ATOMS = ["a", "b", "e", "▁", " ", "  ", "\n", "\t", "é", "漢", "😀", "the", "ing", " of", "1", "0x", "́", "ß", "    ", '"', "'s", "ти", "ние", "\x00", "<s>", "<0x41>", "�"]


def test_equals_the_library(both, spark, sf_dir):
    own, library = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k + "x" for k in range(40)] + ["x" * 300 + " " + "ab" * 200, "", " "]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    memory = {}
    for t, ids in zip(texts, own.encode_texts(texts, memory)):
        assert ids.tolist() == library.encode(t), t
        assert own.decode_ids(ids.tolist()) == library.decode(ids.tolist())


def test_long_units_in_windows(both):
    """Units without spaces, of lengths about the window's and far beyond: letters that tell words apart, runs of one letter whose pieces never fall in step, characters without a piece."""
    own, library = both
    rng = random.Random(2)
    texts = ["abcdefghij" * 5000 + "漢" * 2000 + " " * 500, "x" * 20_000, "=" * 3000 + "-" * 777]
    for size in (33, 64, 65, 255, 256, 257, 300, 448, 449, 512, 1000, 5000):
        texts.append("".join(rng.choice("abcdeinorst") for _ in range(size)))
        texts.append("".join(rng.choice("ab漢é😀\x00 ") if rng.random() < 0.3 else "e" for _ in range(size)).replace(" ", ""))
        texts.append("".join(rng.choice("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0123456789+/=") for _ in range(size)))
    for t, ids in zip(texts, own.encode_texts(texts, {})):
        assert ids.tolist() == library.encode(t)


def test_long_texts_go_in_parts(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(m, "_BATCH_CHARS", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 400))) for _ in range(200)] + ["a" * 500, " " * 300, "\n" * 200]
    for t, ids in zip(texts, own.encode_texts(texts, {})):
        assert ids.tolist() == library.encode(t), t


def test_memory_is_bounded(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(m, "_MOST_UNITS", 5)
    monkeypatch.setattr(m, "_ADVANCE_CHARS", 40)
    memory = {}
    for t in ("one two three four five six seven", "eight nine ten eleven twelve", "one two"):
        assert own.encode_texts([t], memory)[0].tolist() == library.encode(t)


def test_pairs_that_share_a_slot(both, monkeypatch):
    """With 4 slots nearly every pair falls on another's."""
    _, library = both
    monkeypatch.setattr(m, "_PAIR_BITS", 2)
    own = m.Pieces.load(m.MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ATOMS) for _ in range(60)) for _ in range(60)]
    for t, ids in zip(texts, own.encode_texts(texts, {})):
        assert ids.tolist() == library.encode(t), t


def test_pairs_equal_merging(both):
    """The vectorised rule against merging by definition: random pairs, pairs whose strings are pieces, and pairs of one piece with itself."""
    import numpy as np

    own, _ = both
    rng = random.Random(6)
    whole = [i for i in own.ids.values() if own.whole[i]]
    pairs = [(rng.choice(whole), rng.choice(whole)) for _ in range(20_000)] + [(i, i) for i in whole[::7]]
    for p in rng.sample(sorted(own.ids), 6000):
        for c in range(1, len(p)):
            if p[:c] in own.ids and p[c:] in own.ids:
                pairs.append((own.ids[p[:c]], own.ids[p[c:]]))
    pairs = [(a, b) for a, b in pairs if own.whole[a] and own.whole[b]]
    got = own._stay_apart(*np.array(pairs, np.int64).T)
    assert got.tolist() == [own.merged(own.pieces[a] + own.pieces[b]) == [a, b] for a, b in pairs]


def test_unigram_viterbi_equals_all_segmentations():
    """A small unigram model: the best sum over every way to cut a unit."""
    rng = random.Random(3)
    found = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)} | {"a", "b", m.MARK, m.MARK + "a", m.MARK + "ab"})
    scores = [-rng.random() * 9 for _ in found]
    bytes_ = [f"<0x{b:02X}>" for b in range(256)]
    model = m.Pieces(found + bytes_, scores + [0.0] * 256, "N" * len(found) + "B" * 256, bpe=False)
    score = dict(zip(found, scores))

    def best(unit):
        top = None
        for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(unit[start:i])
                    start = i
            if all(p in score or len(p) == 1 for p in parts):
                s = sum(score.get(p, model.unknown) for p in parts)
                if top is None or s > top[0] + 1e-12:
                    top = (s, parts)
        return top

    for _ in range(150):
        unit = m.MARK + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        for encode in (lambda u: model.encode_equal([u, u])[0], model.encode_one):
            import numpy as np

            ids = np.frombuffer(encode(unit), np.int32).tolist()
            total = sum(scores[i] if i < len(found) else model.unknown for i in ids)  # d is the one character without a piece: a single byte
            assert total == pytest.approx(best(unit)[0])
            assert model.decode_ids(ids) == unit.replace(m.MARK, " ")[1:]


def test_round_trip_of_odd_rows(odd, clashing):
    coded = m.encode(odd)
    assert "text" not in coded.columns and coded.columns[-1] == "ids"
    back = rows_of(m.decode(coded), "doc_id", "text")
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=repr)
    out = m.encode(clashing, drop_text=False)
    assert out.columns == [c for c in clashing.columns if c != "ids"] + ["ids"]
    tokens = m.tokens_of(odd)
    assert tokens.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "ids_hash", "round_trip"]
    assert tokens.filter("not round_trip").count() == 0
    assert rows_of(m.tokens_of(clashing), "doc_id", "ids", "n_tokens", "ids_hash") == rows_of(tokens, "doc_id", "ids", "n_tokens", "ids_hash")


def test_ids_are_the_librarys(both, spark, sf_dir):
    """The ids that the query returns, decoded by the library, are the texts; the mark itself decodes to a space."""
    _, library = both
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = m.op7_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and library.decode(r["ids"]) == texts[r["doc_id"]] and r["round_trip"] and r["n_tokens"] == len(r["ids"])
    marked = m.tokens_of(spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string"))
    assert rows_of(marked, "doc_id", "round_trip") == [(1, False), (2, True)]


def test_no_rows_and_null_ids(empty, spark):
    assert m.tokens_of(empty).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [259 + 5])], "doc_id long, ids array<int>")
    got = dict(rows_of(m.decode(rows), "doc_id", "text"))
    assert got[1] is None and got[2] == ""
