import os

import pytest

import corpus_pipeline
from equisift.llm import decontamination, exact_dedup, pieces, quality
from equisift.llm.queries import ORACLE_SQL, QUERIES

from ..compare import assert_same, connect
from .conftest import SCHEMA, Words, rows_of
from .test_classifiers import LABELS, corpus
from .test_decontamination import distance
from .test_exact_dedup import brute as brute_copies
from .test_jaccard_join import brute as brute_near


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_a_row_for_each(spark, sf_dir, name):
    table = "pages" if name.split("_")[0] in ("op3", "op9") else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad texts, copies, near copies, leaks."""
    docs, labels = corpus(4, 120)
    w = Words(4)
    items = [(i, w.text(25, 99)) for i in range(5)]
    more = [docs[i][1] for i in (1, 2, 3, 1, 2)] + ["  " + docs[5][1].replace(" ", "  ")]
    more += [w.near(docs[i][1], 1) for i in (6, 7, 9, 10, 11)]
    more += [w.text(30) + " " + items[k][1] + " " + w.text(30) for k in range(3)] + ["", None, "short one"]
    docs += [(1000 + i, t, None, None, None) for i, t in enumerate(more)] + [docs[13]]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, items


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_run_equals_brute_force(spark, folder):
    import sentencepiece

    at, docs, items = folder
    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    model = quality.train(read("documents"), read("labels"))
    of = model.scorer()
    kept = [r for r in docs if model.probability(of((r[1] or "").encode())) >= 0.5]
    assert len(kept) < len(docs)
    one = {}
    for d, keep, _, i, sha, best in brute_copies(kept):
        if i == best:
            one[sha] = i
    kept = [kept[i] for i in sorted(one.values())]
    stay = {c for _, _, c in brute_near(kept)}
    assert len(stay) < len(kept)
    kept = [r for r in kept if r[0] in stay]
    norm = [decontamination.normalise(t) for _, t in items]
    clean = [r for r in kept if not any(distance(f" {p} ", f" {decontamination.normalise(r[1])} ") <= len(p) // decontamination.CHARS_PER_EDIT for p in norm)]
    assert len(clean) < len(kept)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted(((r[0], len(library.encode(r[1] or "")), True) for r in clean), key=repr)
    assert rows_of(corpus_pipeline.run(spark, at), "doc_id", "n_tokens", "round_trip") == want


def test_stages_keep_columns_and_odd_rows(spark, folder, odd, clashing, empty):
    at = folder[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, at)
        assert out.columns == odd.columns, name
        assert 0 < out.count() <= odd.count()
        assert stage(spark, empty, at).count() == 0
        assert stage(spark, clashing, at).columns == clashing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd, at).count() == odd.count()


def test_copies_leave_one_row(spark, folder, odd):
    left = corpus_pipeline.drop_copies(spark, odd, folder[0])
    assert left.count() == exact_dedup.exact_dedup(odd).select("text_sha256").distinct().count()
