import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "_id", "_sha", "_sha2", "_n", "_stay", "_quality", "row", "own_id", "own_sha", "points", "place", "stay", "sha", "t1", "t2", "key", "salt", "first", "n", "cls", "token", "score", "h", "u", "b", "shard", "slot", "rid", "ids", "spans", "th", "fp", "pos", "stratum", "size", "frac", "removed", "text_sha256", "part", "counts")


class Words:
    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.vocabulary = ["".join(self.rng.choice("abcdefgéñ") for _ in range(self.rng.randint(2, 8))) for _ in range(400)]

    def text(self, n, per_line=12):
        words = [self.rng.choice(self.vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + per_line]) + "." for i in range(0, n, per_line))

    def near(self, text, changes):
        words = text.split(" ")
        for i in self.rng.sample(range(len(words)), min(changes, len(words))):
            words[i] = "".join(self.rng.choice("xyz") for _ in range(6))
        return " ".join(words)


@pytest.fixture
def words():
    return Words(7)


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, odd characters."""
    w = Words(3)
    long = w.text(30_000)
    base = w.text(60)
    texts = [base, base, w.near(base, 2), "", None, "   \n\t ", "a", "A  a", "one two three", "One\ntwo three", long, long, w.near(long, 40), "ß漢😀 ́x\x00y", "x" * 20_000, base.upper(), w.text(80), "\n\n\n"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[10], (None, "null id", None, None, None), (None, base, "en", "s1", 1), (99, w.text(40), None, None, None)]
    return rows


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture
def clashing(odd):
    return odd.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
