import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equisift.config import SelectionConfig
from equisift.functions import prompts
from equisift.functions.rng import uniform_value
from equisift.operators import adaptive, clustering, encoding, evolution, kmeans, metrics, neighbors, reports, sampling
from equisift.operators.predictors import Constant, RemoteEmbedder, RemoteModel, Rule, SimilarityVote
from equisift.plans.selector import FairSelector, run_selection, sweep
from equisift.sources import tables


def brute_metrics(rows):
    """rows: (y, z, yhat)."""
    mean = lambda v: sum(v) / len(v) if v else 0.0
    tp, fp, fn = (sum(1 for y, _, p in rows if (y, p) == k) for k in ((1, 1), (0, 1), (1, 0)))
    m = {"accuracy": mean([y == p for y, _, p in rows]), "precision": tp / (tp + fp) if tp + fp else 0.0, "recall": tp / (tp + fn) if tp + fn else 0.0}
    m["f1_score"] = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    for g in (0, 1):
        m[f"DP_{g}"] = mean([p for _, z, p in rows if z == g])
        m[f"TPR_{g}"] = mean([p for y, z, p in rows if z == g and y == 1])
        m[f"FPR_{g}"] = mean([p for y, z, p in rows if z == g and y == 0])
    m["delta_dp"], m["ratio_dp"] = abs(m["DP_1"] - m["DP_0"]), m["DP_0"] / (m["DP_1"] + 1e-10)
    m["delta_eo"] = max(abs(m["TPR_1"] - m["TPR_0"]), abs(m["FPR_1"] - m["FPR_0"]))
    m["ratio_eo"] = min(m["TPR_0"] / (m["TPR_1"] + 1e-10), m["FPR_0"] / (m["FPR_1"] + 1e-10))
    return m


ALL8 = list(itertools.product((0, 1), (0, 1), (0, 1)))


@pytest.mark.parametrize("rows", [ALL8, ALL8[:5], [(1, 0, 1), (0, 0, 0)], [(1, 0, 0), (0, 1, 0)], [(1, 0, 1), (1, 1, 0)], [(0, 1, 1)] * 3])
def test_metrics(spark, rows):
    got = metrics.evaluate(spark.createDataFrame(rows, "y int, z int, yhat int")).first().asDict()
    want = brute_metrics(rows)
    assert set(got) == set(want) == set(metrics.ALL)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_ratio_is_not_capped(spark):
    got = metrics.evaluate(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "y int, z int, yhat int")).first()
    assert got["ratio_dp"] == pytest.approx(1e10)


def test_evolution_score_has_a_floor(spark):
    row = spark.createDataFrame([(0.1, 0.2, 0.5, 0.9)], "i_f1_score double, i_ratio_eo double, b_f1_score double, b_ratio_eo double")
    assert row.select(metrics.evolution_score("i_", "b_", 0.3, 0.05, "f1_score", "ratio_eo")).first()[0] == pytest.approx(0.05)
    assert row.select(metrics.evolution_score("i_", "b_", 0.5, 0.05, "f1_score", "ratio_eo", True)).first()[0] == pytest.approx(0.5 * 0.05 + 0.5 * 0.7)


def test_clean_drops_columns_first(spark):
    df = spark.createDataFrame([(1, "a", "?"), (2, "?", "x"), (3, None, "y"), (4, "b", None)], "i int, kept string, gone string")
    assert sorted(r["i"] for r in encoding.clean(df, ("gone",)).collect()) == [1, 4]
    assert [r["i"] for r in encoding.clean(df).collect()] == []


def test_codes_are_sorted_not_by_frequency(spark):
    df = spark.createDataFrame([(v,) for v in "baaac"], "s string")
    assert {r["value"]: r["code"] for r in encoding.codes(df, "s").collect()} == {"a": 0, "b": 1, "c": 2}
    other = spark.createDataFrame([("b",), ("z",), (None,)], "s string")
    assert sorted(r["s"] for r in encoding.encode(other, ["s"], fit=df).collect()) == [-1, -1, 1]


def test_cells_drop_other_values(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (None, 0)], "z int, y int")
    assert sorted(r["sg"] for r in encoding.cells(df).collect()) == ["g01", "g10"]


@pytest.mark.parametrize("ratio", [0.2, 0.5, 0.01])
def test_split_is_exact(spark, ratio):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    got = {(r["y"], r["split"]): r["count"] for r in sampling.stratified_split(df, "y", ratio, 1).groupBy("y", "split").count().collect()}
    for y, n in ((0, 857), (1, 143)):
        assert got.get((y, "dev"), 0) == int(n * ratio + 0.5)


def test_roulette(spark):
    df = spark.createDataFrame([("g", i, 0.0 if i < 5 else 1.0) for i in range(10)] + [("h", 99, 0.0)], "sg string, row_id long, score double")
    for r in range(3):
        got = [x["row_id"] for x in sampling.roulette(df, "sg", 5, 3, r).collect()]
        assert sorted(got) == [5, 6, 7, 8, 9, 99]
    assert sorted(x["row_id"] for x in sampling.roulette(df, "sg", 7, 3, 0).collect()) == [0, 1, 5, 6, 7, 8, 9, 99]
    assert sampling.roulette(df, "sg", 0, 3, 0).count() == 0


def test_roulette_prefers_weight(spark):
    df = spark.createDataFrame([("g", i, 9.0 if i % 2 else 1.0) for i in range(400)], "sg string, row_id long, score double")
    assert sum(x["row_id"] % 2 for x in sampling.roulette(df, "sg", 100, 5, 0).collect()) > 75


def test_top_k_edges(spark):
    df = spark.createDataFrame([("g", 3, 1.0), ("g", 1, 1.0), ("g", 2, 2.0)], "sg string, row_id long, score double")
    assert sampling.top_k(df, "sg", 0).count() == 0
    assert [r["row_id"] for r in sampling.top_k(df, "sg", 9).orderBy("rank").collect()] == [2, 1, 3]


def test_global_rank_and_batches(spark):
    ids = random.Random(1).sample(range(10_000), 503)
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(5)
    assert [(r["k"], r["pos"]) for r in sampling.global_rank(df, "k").orderBy("k").collect()] == [(k, i) for i, k in enumerate(sorted(ids))]
    assert sampling.batch_ids(df, "k", 100).groupBy("batch_id").count().filter("batch_id = 5").first()["count"] == 3


def test_first_of_each(spark):
    raw = ['"b"', " a ", "b", "'a'", "", None, "c"]
    df = spark.createDataFrame(list(enumerate(raw)), "pos int, k string")
    assert {r["key"]: r["pos"] for r in sampling.first_of_each(df, "k", "pos").collect()} == {"b": 0, "a": 1, "c": 6}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "row_id long, v array<double>")


def test_nearest_edges(spark):
    pool = vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0]), (5, None)])
    q = vectors(spark, [(1, [5.0, 0.0]), (2, [0.0, 0.0])])
    got = {}
    for r in neighbors.nearest(q, pool, 9).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["p_id"], r["sim"]))
    assert got == {1: [(2, 1.0), (3, 1.0), (1, 0.0), (4, -1.0)], 2: [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]}
    assert [r["p_id"] for r in neighbors.nearest(q, pool, 1).orderBy("q_id").collect()] == [2, 1]
    assert [r["p_id"] for r in neighbors.nearest(q, pool, 1, exclude_self=True).orderBy("q_id").collect()] == [2, 1]
    assert neighbors.nearest(q, pool, 0).count() == 0
    assert neighbors.nearest(q, pool.filter("row_id > 99"), 3).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbors, "POOL_BLOCK", 11)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    df = vectors(spark, rows)
    got = {(r["q_id"], r["rank"]): r["p_id"] for r in neighbors.nearest(df, df, 4, exclude_self=True).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for i, v in rows:
        sims = sorted((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 9), j) for j, w in rows if j != i)
        assert [got[i, r] for r in range(1, 5)] == [j for _, j in sims[:4]]


@pytest.mark.parametrize("exclude_self", [True, False])
def test_pivots_prune_and_stay_exact(spark, exclude_self):
    """Groups of vectors, zero vectors, many equal ones; results of all pairs from a few of them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 10
    v = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres] + [np.zeros((9, 6)), np.tile(centres[0], (90, 1))])
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(len(v)), v)]
    df = vectors(spark, rows).repartition(4)
    report = {}
    found = neighbors.nearest(df.filter("row_id % 3 = 0"), df, 7, exclude_self, pool_block=16, query_block=20, report=report)
    got = {(r["q_id"], r["rank"]): (r["p_id"], r["sim"]) for r in found.collect()}
    units = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    ids, queries = np.array([r[0] for r in rows]), [n for n, r in enumerate(rows) if r[0] % 3 == 0]
    assert len(got) == 7 * len(queries) and report["of"] == len(rows) * len(queries) and report["pairs"] < report["of"] / 2
    for n in queries:
        sims = sorted((-round(float(s), 9) + 0.0, j) for s, j in zip(units @ units[n], ids) if j != ids[n] or not exclude_self)
        assert [got[int(ids[n]), r] for r in range(1, 8)] == [(j, -s + 0.0) for s, j in sims[:7]]


def test_pivots_of_zero_vectors_only(spark):
    df = vectors(spark, [(i, [0.0, 0.0]) for i in range(20)])
    got = sorted((r["q_id"], r["rank"], r["p_id"], r["sim"]) for r in neighbors.nearest(df.filter("row_id < 2"), df, 2, True, pool_block=4).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 0, 0.0), (1, 2, 2, 0.0)]


def test_neighbours_are_dealt_by_their_work(spark, monkeypatch):
    """One file's rows are placed, and blocks meet, in as many tasks as their distances need, and the result stays exact."""
    df = vectors(spark, [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(6).normal(size=(400, 3)))]).coalesce(1)
    few = sorted(map(tuple, neighbors.nearest(df, df, 3, True, pool_block=20).collect()))
    tasks, settled = [], neighbors.settle
    monkeypatch.setattr(neighbors, "settle", lambda x: tasks.append(x.rdd.getNumPartitions()) or settled(x))
    monkeypatch.setattr(neighbors, "TASK_CELLS", 200, raising=False)
    assert sorted(map(tuple, neighbors.nearest(df, df, 3, True, pool_block=20).collect())) == few
    assert tasks[0] == tasks[1] == 400 * 20 // 200


def test_neighbours_in_parts_of_bounded_memory(spark, monkeypatch):
    """A batch meets the pivots in parts of at most CELLS distances, whatever the batch and however many pivots."""
    df = vectors(spark, [(i, [float(i % 7), 1.0]) for i in range(300)]).coalesce(1)
    monkeypatch.setattr(neighbors, "CELLS", 60, raising=False)
    sizes = neighbors._in_arrow(df.select("row_id", "v"), lambda batch, units: [pa.array(np.full(len(units), len(units), np.int32))], "size int", 15).collect()
    assert len(sizes) == 300 and {r["size"] for r in sizes} == {4}
    whole = sorted(map(tuple, neighbors.nearest(df, df, 3, pool_block=40).collect()))
    monkeypatch.undo()
    assert whole == sorted(map(tuple, neighbors.nearest(df, df, 3, pool_block=40).collect()))


def test_pivots_need_no_workers_of_their_own(spark):
    """The small table of pivots is local: made from an RDD, it would start a second set of Python workers in each executor."""
    v = F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")
    placed, reached = spark.range(9).select("id", v, F.lit(0).alias("pivot")), spark.range(4).select("id", v, F.lit(-1.0).alias("least"), F.array(F.lit(0)).alias("pivots"))
    for side in neighbors._sides(placed, reached, {0: (9, 0.0, 0.0)}, {0: 4}, 5, 3, lambda n: F.pmod("id", n).cast("int")):
        plan = side._jdf.queryExecution().toString()
        assert "LocalTableScan" in plan and "ExistingRDD" not in plan
        assert side.count() == {"least": 8, "id": 18}["least" if "least" in side.columns else "id"]


def test_meetings_round_what_reaches_the_floor(spark):
    """Rows a rounding apart are ties by id, at the floor and at the k-th place, and a floor holds for the rounded similarity."""
    turn = lambda a: [math.cos(a), math.sin(a)]
    pool = [(9 - i, turn(0.5 + i * 1e-11)) for i in range(8)] + [(20, turn(0.2)), (21, turn(1.2)), (22, [0.0, 0.0]), (23, [math.nan, 1.0])]
    tied = round(math.cos(0.5), 9)
    block = [F.lit(0).alias(x) for x in ("pivot", "part", "block")]
    right = vectors(spark, pool).select(F.col("row_id").alias("id"), "v", *block)
    for least, ids in ((-math.inf, [20, 2, 3]), (tied, [20, 2, 3]), (tied + 2e-9, [20]), (1.0, [])):
        left = vectors(spark, [(1, [1.0, 0.0])]).select(F.col("row_id").alias("id"), "v", F.lit(least).alias("least"), *block)
        got = sorted(neighbors._meetings(left, right, 3, False).collect(), key=lambda r: (-r["sim"], r["p_id"]))
        assert [r["p_id"] for r in got] == ids and all(r["sim"] == round(r["sim"], 9) for r in got)


def test_validation_keeps_copies_and_candidates_leave_it_out(spark):
    sets = spark.createDataFrame([(0, 1, 1, 7), (0, 2, 1, 7), (0, 1, 2, 8), (0, 2, 2, 9)], "batch_id long, q_id long, rank int, p_id long")
    assert [r["p_id"] for r in neighbors.validation(sets).collect()] == [7, 7]
    assert sorted(r["p_id"] for r in neighbors.candidates(sets).collect()) == [8, 9]


def cell_rows(spark, sizes):
    rng = random.Random(2)
    return spark.createDataFrame([(s, n * 1000 + i, [rng.random(), rng.random()]) for n, (s, size) in enumerate(sizes.items()) for i in range(size)], "sg string, row_id long, v array<double>")


@pytest.mark.parametrize("k,m", [(3, 2), (4, 5), (1, 1), (2, 0)])
def test_number_of_representatives(spark, k, m):
    sizes = {"g00": 1, "g01": 4, "g10": 30}
    df = cell_rows(spark, sizes)
    out = clustering.representatives(df, clustering.lloyd(df, k, 2, 1), k, m)
    got = {r["sg"]: r["count"] for r in out.groupBy("sg").count().collect()}
    assert got == {s: min(k * m, n) for s, n in sizes.items() if min(k * m, n)}
    assert out.select("row_id").distinct().count() == sum(got.values())


def test_empty_cluster_keeps_its_centroid(spark):
    df = spark.createDataFrame([("g", 1, [0.0]), ("g", 2, [1.0])], "sg string, row_id long, v array<double>")
    centres, cost = kmeans.run(df, {"g": {0: np.array([[0.5], [99.0]])}}, 5)
    assert centres["g"][0].tolist() == [[0.5], [99.0]] and cost == {("g", 0): 0.5}


def groups_of_points(seed, groups, each, dim=8, cells=2):
    """Rows of each cell around far centres, some with many more rows than others."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(cells):
        centres = rng.normal(size=(groups, dim)) * 20
        for g in range(groups):
            out += [(f"c{c}", v) for v in centres[g] + rng.normal(size=(each * (1 + g % 4), dim))]
    return [(sg, i, [float(x) for x in v]) for i, (sg, v) in enumerate(out)]


def test_parallel_seeding_costs_no_more(spark):
    """The cost of the seeds themselves, and after Lloyd's rounds, on five seeds: never above that of uniform seeds."""
    df = spark.createDataFrame(groups_of_points(1, 8, 20), "sg string, row_id long, v array<double>")
    for seed in range(5):
        for rounds in (0, 3):
            a, b = (kmeans.run(df, make(df, 8, seed, 1), rounds)[1] for make in (kmeans.parallel_seeds, kmeans.uniform_seeds))
            assert set(a) == set(b) and all(a[key] <= b[key] for key in b)


def test_seeds_by_hand(spark):
    """Draws and picks against loops over rows, with repeated rows and a cell of few distinct ones."""
    data = groups_of_points(2, 3, 5, 2) + [("one", 900 + i, [1.0, 2.0]) for i in range(7)] + [("two", 950 + i, [float(i % 2), 0.0]) for i in range(9)]
    df = spark.createDataFrame(data, "sg string, row_id long, v array<double>").repartition(5)
    found = kmeans.candidates(df, 7, 2, 2, 4)
    for sg in ("c0", "c1", "one", "two"):
        own = [(i, np.array(v)) for s, i, v in data if s == sg]
        far = lambda v, got: min(round(float(np.sqrt(((v - g) ** 2).sum())), 9) for _, g in got)
        for s in range(2):
            got = sorted(own, key=lambda r: uniform_value(7, "kmeans", s, r[0]))[:1]
            for r in (1, 2):
                raced = [(-np.log(uniform_value(7, "seeding", f"{s}.{r}", i)) / far(v, got) ** 2, i, v) for i, v in own if far(v, got) > 0]
                got = got + [(i, v) for _, i, v in sorted(raced, key=lambda x: x[:2])[:4]]
            assert [x[0] for x in found[sg, s]] == sorted(i for i, _ in got)
            assert sum(x[2] for x in found[sg, s]) == len(own)
    assert len(kmeans.picked(found["one", 0], 4, 7, 0)) == 1 and len(kmeans.picked(found["two", 1], 4, 7, 1)) == 2
    seeds = kmeans.parallel_seeds(df, 4, 7, 2)
    assert {sg: {s: len(c) for s, c in own.items()} for sg, own in seeds.items()} == {"c0": {0: 4, 1: 4}, "c1": {0: 4, 1: 4}, "one": {0: 1, 1: 1}, "two": {0: 2, 1: 2}}


def test_starts_together_equal_starts_alone(spark):
    df = spark.createDataFrame(groups_of_points(3, 4, 6, 3), "sg string, row_id long, v array<double>")
    seeds = kmeans.uniform_seeds(df, 4, 5, 6)
    centres, cost = kmeans.run(df, seeds, 50)
    for s in range(6):
        alone, own = kmeans.run(df.repartition(3), {sg: {s: c[s]} for sg, c in seeds.items()}, 50)
        assert all(np.array_equal(alone[sg][s], centres[sg][s]) and own[sg, s] == cost[sg, s] for sg in seeds)
        # Settled: every centroid is the mean of the rows nearest to it.
        assert all(np.array_equal(kmeans.run(df, {sg: {s: centres[sg][s]}}, 1)[0][sg][s], centres[sg][s]) for sg in seeds)


def test_no_rows_to_cluster(spark):
    df = spark.createDataFrame([], "sg string, row_id long, v array<double>")
    assert clustering.lloyd(df, 3, 5, 1, 4).collect() == [] == clustering.lloyd(df, 3, 5, 1, 4, "parallel").collect()
    with pytest.raises(ValueError):
        clustering.lloyd(df, 3, 5, 1, seeding="other")


@pytest.mark.parametrize(
    "text,want",
    [("Greater than 50K", 1), (" >50k ", 1), ("greater than 50 k", 1), ("less than or equal to 50K", 0), ("<=50K", 0), ("not greater than 50k", 1), ("", 0), ("who knows", 0)],
)
def test_parse(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(prompts.parse_response("t")).first()[0] == want


def test_mask(spark):
    df = spark.createDataFrame([(None,), ("",), ("12345678",), ("123456789",)], "k string")
    assert [r[0] for r in df.select(prompts.mask_key("k")).collect()] == ["NONE", "NONE", "****", "1234...6789"]


PERSON = "set_id int, row_id long, age int, workclass string, education string, marital_status string, occupation string, relationship string, sex int, capital_gain int, capital_loss int, hours_per_week int, income int"


def test_prompt(spark):
    p = spark.createDataFrame([(1, 1, 30, "w", "e", "m", "o", "r", 1, 5, 6, 40, 1), (1, 2, 31, "w", "e", "m", "o", "r", 9, 5, 6, 40, 0)], PERSON)
    demos = p.withColumn("pos", -F.col("row_id"))
    text = prompts.prompts(p.filter("row_id = 1"), demos, ["set_id"]).first()["prompt"]
    assert text.startswith(prompts.TASK + "\n\nHere are some examples:\n\nAge: 31, ")
    assert "Sex: 9, " in text and "Sex: Female, " in text and " -> Income: greater than 50K\n" in text
    assert text.endswith("Hours per Week: 40\n\nIncome prediction:")
    assert "Income: >50K" in p.select(prompts.embedding_row(True)).first()[0] and "Income" not in p.select(prompts.embedding_row()).first()[0]
    assert "examples" not in prompts.prompts(p, None, ["set_id"]).first()["prompt"]


def test_predictors(spark):
    test = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [-1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 1, [0.0, 0.0])], "set_id string, row_id long, v array<double>")
    demos = spark.createDataFrame([("a", 7, 1, [2.0, 0.0]), ("a", 8, 0, [0.0, 3.0]), ("c", 7, 1, [1.0, 0.0])], "set_id string, row_id long, y int, v array<double>")
    got = {(r["set_id"], r["row_id"]): r["yhat"] for r in SimilarityVote().predict(test, demos).collect()}
    assert got == {("a", 1): 1, ("a", 2): 0, ("b", 1): 0, ("c", 1): 0}
    assert {r["yhat"] for r in Constant().predict(test).collect()} == {0}
    assert sum(r["yhat"] for r in Rule("row_id = 1").predict(test).collect()) == 3


def test_remote_model_fails_over(spark):
    def clients():
        def bad(prompt):
            raise OSError("down")

        return [bad, lambda p: "greater than 50K" if "rich" in p else "<=50K"]

    test = spark.createDataFrame([("s", 1, "rich"), ("s", 2, "poor")], "set_id string, row_id long, prompt string")
    assert {r["row_id"]: r["yhat"] for r in RemoteModel(clients).predict(test).collect()} == {1: 1, 2: 0}
    assert {r["yhat"] for r in RemoteModel(lambda: []).predict(test).collect()} == {0}


def test_remote_embedder_gives_zeros_on_failure(spark):
    def make():
        def embed(texts):
            if "bad" in texts:
                raise OSError
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    df = spark.createDataFrame([(1, "ab"), (2, "bad")], "i int, text string").coalesce(1)
    assert {r["i"]: r["v"] for r in RemoteEmbedder(make, dim=2, batch=1).embed(df).collect()} == {1: [2.0, 1.0], 2: [0.0, 0.0]}


def brute_search(pool, sets, rounds):
    """One batch; pool: id -> (y, z, v); sets: q -> [p ids by rank]."""
    unit = lambda v: [x / (sum(a * a for a in v) ** 0.5 or 1) for x in v]
    valid = [pool[s[0]] for _, s in sorted(sets.items())]

    def error(demos):
        rows = []
        for y, z, v in valid:
            vote = sum(sum(a * b for a, b in zip(unit(v), unit(pool[d][2]))) * (2 * pool[d][0] - 1) for d in demos)
            rows.append((y, z, int(round(vote, 9) > 0)))
        m = brute_metrics(rows)
        return round(0.5 * (1 - m["f1_score"]) + 0.5 * abs(m["DP_0"] - m["DP_1"]), 9)

    core = {q: [s[1] if len(s) > 1 else s[0]] for q, s in sets.items()}
    after, best, best_err, trace = dict.fromkeys(sets, 2), None, float("inf"), []
    for _ in range(rounds):
        own = {q: error(c) for q, c in core.items()}
        union = [d for _, c in sorted(core.items()) for d in c]
        err = error(union)
        if err < best_err:
            best, best_err = union, err
        weakest = max(sorted(own), key=lambda q: (own[q], -q))
        trace.append((err, weakest, len(union)))
        if after[weakest] < len(sets[weakest]):
            core[weakest] = core[weakest] + [sets[weakest][after[weakest]]]
            after[weakest] += 1
    return sorted(best), trace


class AskedByRounds:
    """The same votes, from a predictor that doesn't say that they add up."""

    def predict(self, test, demos=None):
        return SimilarityVote().predict(test, demos)


@pytest.mark.parametrize("predictor", [SimilarityVote(), AskedByRounds()])
def test_adaptive_search(spark, predictor):
    """Four batches, with a lone neighbour, sets of unlike sizes and more rounds than neighbours."""
    pools, sets, pool = {}, {}, {}
    for batch in range(4):
        rng = random.Random(batch)
        own = {100 * batch + i: (rng.randint(0, 1), rng.randint(0, 1), [rng.gauss(0, 1) for _ in range(3)]) for i in range(12)}
        pool |= own
        pools[batch] = own
        sets[batch] = {10 * batch + q: rng.sample(sorted(own), 1 if q == 3 else 2 + (q + batch) % 3) for q in range(5)}
    rows = spark.createDataFrame([(i, *x) for i, x in pool.items()], "row_id long, y int, z int, v array<double>")
    df = spark.createDataFrame([(b, q, r, p) for b, own in sets.items() for q, s in own.items() for r, p in enumerate(s, 1)], "batch_id long, q_id long, rank int, p_id long")
    rounds = 6 if isinstance(predictor, SimilarityVote) else 2
    best, trace = adaptive.search(df, rows, predictor, rounds)
    got, found = {}, {}
    for r in trace.orderBy("round").collect():
        got.setdefault(r["batch_id"], []).append((r["err"], r["weakest"], r["n"]))
    for r in best.collect():
        found.setdefault(r["batch_id"], []).append(r["p_id"])
    for b in sets:
        want_best, want = brute_search(pools[b], sets[b], rounds)
        assert got[b] == want and sorted(found[b]) == want_best


def test_search_without_rounds(spark):
    rows = spark.createDataFrame([(1, 0, 1, [1.0]), (2, 1, 0, [2.0])], "row_id long, y int, z int, v array<double>")
    df = spark.createDataFrame([(0, 5, 1, 1), (0, 5, 2, 2), (0, 6, 1, 2)], "batch_id long, q_id long, rank int, p_id long")
    best, trace = adaptive.search(df, rows, SimilarityVote(), 0)
    assert sorted(r["p_id"] for r in best.collect()) == [2, 2] and trace.count() == 0


def selection_rows(spark, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y, z = rng.randint(0, 1), rng.randint(0, 1)
        out.append((i, y, z, [rng.gauss(2 * y - 1, 1), rng.gauss(z, 1)]))
    return spark.createDataFrame(out, "row_id long, y int, z int, v array<double>")


def test_both_phases(spark, tmp_path):
    config = SelectionConfig(n_clusters=2, m_neighbors=3, k_shots=2, iterations=2, search_rounds=2, max_test_samples=25, lloyd_rounds=1)
    train, test = selection_rows(spark, 200, 1), selection_rows(spark, 30, 2)
    s = FairSelector(config).load(train).fit()
    assert s.scored.filter(F.col("score") < config.floor - 1e-9).count() == 0
    assert s.select_demonstrations().groupBy("sg").count().filter("count = 2").count() == 4
    out = run_selection(train, test, config)
    got = {r["method"]: r["accuracy"] for r in out.collect()}
    assert set(got) == {"zero_shot", "few_shot", "adaptive"} and got["few_shot"] > 0.6
    run = tables.write_results(out, str(tmp_path / "r"), config=config)
    back = spark.read.csv(str(tmp_path / f"r/run={run}"), header=True)
    assert run.startswith("results_2") and back.columns == ["type", "method", "metric", "value"] and back.filter("type = 'evaluation'").count() == 3 * 14
    tables.write_report(out, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).filter("value like '%Accuracy%'").count() == 3
    assert reports.improvements(out, "zero_shot", "few_shot").count() == 1


FAIR = ("ratio_eo", "delta_dp")


def test_metrics_evolve_side_by_side(spark):
    """Each metric's scores are those that it has alone; only rows drawn have moved."""
    rows = selection_rows(spark, 80, 1).withColumn("sg", F.concat(F.lit("g"), "z", "y")).withColumn("score", 0.2 + F.col("row_id") % 5 / 10)
    dev = selection_rows(spark, 40, 2)
    both = evolution.evolve(rows, dev, SimilarityVote(), 3, 4, 1, metric_fair=FAIR, zero_shot=Rule("v[0] > 0.5"))
    got = {(r["metric_fair"], r["row_id"]): r["score"] for r in both.collect()}
    assert len(got) == 2 * rows.count()
    first = {r["row_id"]: r["score"] for r in rows.collect()}
    for m in FAIR:
        alone = {r["row_id"]: r["score"] for r in evolution.evolve(rows, dev, SimilarityVote(), 3, 4, 1, metric_fair=m, zero_shot=Rule("v[0] > 0.5")).collect()}
        assert alone == {i: s for (k, i), s in got.items() if k == m}
        assert 4 <= sum(s != first[i] for i, s in alone.items()) <= 3 * 4 * 4


def test_log_is_folded_in_order(spark):
    scored = spark.createDataFrame([("m", "g", 1, 1.0), ("m", "g", 2, 1.0), ("n", "g", 1, 8.0)], "metric_fair string, sg string, row_id long, score double")
    log = spark.createDataFrame([("m", "g", 1, 0.5, 2), ("m", "g", 1, 0.2, 1)], "metric_fair string, sg string, row_id long, e double, round int")
    got = {(r["metric_fair"], r["row_id"]): r["score"] for r in evolution.with_log(scored, log).collect()}
    assert got == {("m", 1): pytest.approx(((1.0 + 0.2) / 2 + 0.5) / 2), ("m", 2): 1.0, ("n", 1): 8.0}


def test_sweep_equals_single_runs(spark):
    config = SelectionConfig(n_clusters=2, m_neighbors=3, k_shots=2, iterations=2, max_test_samples=25, lloyd_rounds=1, lloyd_starts=2)
    train, test = selection_rows(spark, 120, 1), selection_rows(spark, 30, 2)
    got = {(r["metric_fair"], r["method"]): tuple(r)[2:] for r in sweep(train, test, list(FAIR), config).collect()}
    assert len(got) == 4
    for m in FAIR[:1]:
        alone = {r["method"]: tuple(r[c] for c in metrics.ALL) for r in run_selection(train, test, replace(config, metric_fair=m), adaptive_search=False).collect()}
        assert alone == {method: v for (k, method), v in got.items() if k == m}


def test_census(spark, tmp_path):
    line = "39, Private, 1, B, 13, Never, {}, Rel, White, {}, 0, 0, 40, {}, {}\n"
    (tmp_path / "a").write_text(line.format("X", "Male", "?", "<=50K") + line.format("?", "Male", "US", ">50K") + line.format("Y", "Female", "US", ">50K"))
    (tmp_path / "b").write_text(line.format("Z", "Female", "US", "<=50K."))
    got = tables.census(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("part", "row_id").collect()
    assert [(r["part"], r["occupation"], r["sex"], r["income"]) for r in got] == [("test", -1, 0, 0), ("train", 0, 1, 0), ("train", 1, 0, 1)]


def test_cached_is_keyed_by_parameters(spark, tmp_path):
    a, b = SelectionConfig(seed=1), SelectionConfig(seed=2)
    for c, n in ((a, 3), (b, 4), (a, 9)):
        got = tables.cached(spark, str(tmp_path), "x", c, lambda n=n: spark.range(n)).count()
        assert got == (4 if c is b else 3)


def test_stream(spark, tmp_path):
    from equisift.streaming.scoring import score_stream

    rows = selection_rows(spark, 20, 3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, selection_rows(spark, 10, 4), SimilarityVote(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_config_is_checked():
    with pytest.raises(ValueError):
        SelectionConfig(alpha=2)
    assert SelectionConfig().key() != SelectionConfig(seed=1).key()


def test_estimate(spark):
    from equisift.operators.estimate import estimate

    config = spark.createDataFrame(
        [("no search", 2, 10, 21, 3, 10, 5, 3, False), ("search", 2, 10, 21, 3, 10, 5, 3, True)],
        "name string, k_shots int, max_dev_samples int, max_test_samples int, iterations int, batch_size int, k_neighbors int, l_iterations int, with_search boolean",
    )
    few = 170 + 8 * 70
    got = {r["name"]: r for r in estimate(config).collect()}
    for name, calls in (("no search", 0), ("search", 3 * 10 * 10 * 3)):
        r = got[name]
        assert r["grand_total_calls"] == 10 + 30 + 42 + calls and r["search_calls"] == calls
        assert r["grand_total_tokens"] == 10 * 155 + 30 * few + 21 * (155 + few) + calls * (170 + 5 * 70)
        assert r["estimated_cost_usd"] == pytest.approx(r["grand_total_tokens"] * 1.05e-7, abs=1e-6)


def test_estimate_of_the_usual_settings(spark):
    """The published totals: 10,620 calls, 9,922,100 tokens, 1.0418 dollars."""
    from equisift.operators.estimate import estimate

    config = spark.createDataFrame([("usual", 10, 20, 200, 10, 10, 10, 5, True)], "name string, k_shots int, max_dev_samples int, max_test_samples int, iterations int, batch_size int, k_neighbors int, l_iterations int, with_search boolean")
    r = estimate(config).first()
    assert (r["grand_total_calls"], r["grand_total_tokens"], round(r["estimated_cost_usd"], 4)) == (10_620, 9_922_100, 1.0418)


def test_csv_row_ids_do_not_depend_on_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part{f}.csv").write_text("".join(f"{f}, {i}\n" for i in range(700 + 100 * f)))
    want = [(f, i) for f in range(3) for i in range(700 + 100 * f)]
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r["row_id"]: (r["f"], r["i"]) for r in tables.read_csv(spark, str(tmp_path), "f int, i int").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == dict(enumerate(want))


def test_cached_is_keyed_by_content(spark, tmp_path):
    c, made = SelectionConfig(), []
    one, other = spark.range(5), spark.range(5).withColumn("id", F.col("id") + (F.col("id") == 4).cast("int"))
    for source in (one, other, one.repartition(3), one.union(one).union(one), one):
        tables.cached(spark, str(tmp_path), "x", c, lambda source=source: made.append(1) or source, source)
    assert len(made) == 3


def test_keys_and_clients(spark, monkeypatch):
    from equisift.operators.predictors import clients_from_keys

    rows = spark.createDataFrame([(1, '\t"abc"\n'), (2, "abc"), (3, "\u00a0'x' "), (4, None), (5, "")], "pos int, k string")
    assert sorted(map(tuple, sampling.first_of_each(rows, "k", "pos").collect())) == [("abc", 1), ("x", 3)]
    for n, v in (("OWN_KEY", " 'a' "), ("OWN_KEY1", "b"), ("OWN_KEY_2", '"a"'), ("OWN_KEY_3", "")):
        monkeypatch.setenv(n, v)
    assert clients_from_keys(lambda k: k, names=("OWN_KEY",)) == ["a", "b"]
    with pytest.raises(ValueError):
        clients_from_keys(lambda k: k, keys=["", " "])


def test_logger(tmp_path):
    import logging

    from equisift.functions.logs import get_logger, setup_logger

    before = len(logging.getLogger().handlers)
    for _ in range(2):
        log = setup_logger("equisift.test", str(tmp_path / "logs/run.log"))
    get_logger("equisift.test").info("said once")
    assert len(log.handlers) == 2 and (tmp_path / "logs/run.log").read_text().count("said once") == 1 and len(logging.getLogger().handlers) == before
    for h in list(log.handlers):
        h.close()
        log.removeHandler(h)


def test_lloyd_restarts_and_converges(spark):
    """Three far groups in each of 12 cells: single starts end in poor optima of some cell, ten starts in none."""
    rng = random.Random(3)
    rows = [(f"c{c}", 100 * c + i, [rng.random() + (0, 100, 112)[i % 3], rng.random()]) for c in range(12) for i in range(18)]
    df = spark.createDataFrame(rows, "sg string, row_id long, v array<double>")
    cost = lambda centroids: {r["sg"]: r["cost"] for r in clustering.assign(df, centroids).groupBy("sg").agg(F.sum(F.col("dist") * F.col("dist")).alias("cost")).collect()}
    assert max(cost(clustering.lloyd(df, 3, 2, 1)).values()) > 100
    many = clustering.lloyd(df, 3, 300, 1, 10)
    assert max(cost(many).values()) < 10 and many.count() == 36
    own = {}
    for r in sorted(many.collect(), key=lambda r: r["cluster"]):
        own.setdefault(r["sg"], {0: []})[0].append(r["c"])
    again, _ = kmeans.run(df, {sg: {0: np.array(c[0])} for sg, c in own.items()}, 1)
    assert all(again[sg][0].tolist() == c[0] for sg, c in own.items())


def test_score_extremes(spark):
    rows = [("a", 0.5), ("a", 0.5), ("a", 0.1), ("a", 0.9), ("a", None), ("b", 2.0), ("b", 1.0)]
    got = {}
    for r in reports.score_extremes(spark.createDataFrame(rows, "sg string, score double")).orderBy("rank").collect():
        got.setdefault((r["sg"], r["kind"]), []).append(r["score"])
    assert got == {("a", "top"): [0.9, 0.5, 0.5], ("a", "bottom"): [0.1, 0.5, 0.5], ("b", "top"): [2.0, 1.0], ("b", "bottom"): [1.0, 2.0]}


def test_report_on_the_console(spark, capsys):
    pred = spark.createDataFrame([("b", 1, 0, 1), ("a", 1, 0, 0)], "method string, y int, z int, yhat int")
    reports.print_report(metrics.evaluate(pred, ["method"]))
    said = capsys.readouterr().out.splitlines()
    assert said[0] == "A RESULTS" and said[1] == "  Accuracy: 0.0000" and said[15] == "B RESULTS" and said[16] == "  Accuracy: 1.0000" and len(said) == 30
