"""Adaptive refinement of demonstration sets: for each batch, expand the weakest row's set, keep the best union.

With a predictor whose votes add up, all rounds of all batches are one plan. A set of a given size has the same error in whatever round it is met, so votes are summed up along the ranks once, the errors of all sizes of
all sets follow in one aggregation, and the path of a batch (which set grows in which round) is a fold over its few errors. Only the unions of the rounds are left to be judged: each adds up the sums of its sets.
Other predictors are asked round by round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import settle
from .metrics import combined_error, evaluate
from .neighbors import validation
from .predictors import Predictor


def _errors(sets: DataFrame, valid: DataFrame, rows: DataFrame, predictor: Predictor, alpha: float, metric_pred: str, keys: list[str]) -> DataFrame:
    """(keys, err): the combined error of each demonstration set on its batch's validation rows. sets: (keys, p_id); valid: (batch_id, q_id, p_id)."""
    set_id = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    demos = sets.join(rows.withColumnRenamed("row_id", "p_id"), "p_id").withColumn("set_id", set_id).withColumnRenamed("p_id", "row_id")
    test = sets.select(*keys).distinct().join(valid.select("batch_id", F.col("q_id").alias("_q"), "p_id"), "batch_id").withColumn("set_id", set_id)
    test = test.join(rows.withColumnRenamed("row_id", "p_id"), "p_id").withColumn("row_id", F.col("_q"))  # a validation row counts once for each query
    pred = predictor.predict(test, demos).join(test.select("set_id", "row_id", "y", "z", *keys), ["set_id", "row_id"])
    return evaluate(pred, keys).select(*keys, F.round(combined_error(alpha, metric_pred), 9).alias("err"))


def search(sets: DataFrame, rows: DataFrame, predictor: Predictor, rounds: int, alpha: float = 0.5, metric_pred: str = "f1_score") -> tuple[DataFrame, DataFrame]:
    """(best, trace) of the search. sets: (batch_id, q_id, rank, p_id); rows: (row_id, y, z, v) of the pool.

    Each query's set begins with its second neighbour (the first, if it has no other) and grows by one neighbour when it is the weakest of its
    batch: greatest own error, ties by the least id; the last growth isn't judged, and a weakest set without further neighbours stays. best: (batch_id, p_id) of the union with the least
    error (earliest on ties), copies kept; trace: (batch_id, round, err, weakest, n). With no rounds best is the first union and trace is empty.
    """
    if rounds < 1:
        first = _states(sets).filter(F.col("rank").between(2, 2) | ((F.col("most") == 1) & (F.col("rank") == 1)))
        return first.select("batch_id", "p_id"), rows.sparkSession.createDataFrame([], "batch_id long, round int, err double, weakest long, n long")
    by_sums = hasattr(predictor, "vote")
    return (_by_sums if by_sums else _by_rounds)(sets, rows, predictor, rounds, alpha, metric_pred)


def _states(sets: DataFrame) -> DataFrame:
    """sets with `most`, the greatest rank of the query's."""
    return sets.select("batch_id", "q_id", "rank", "p_id").withColumn("most", F.max("rank").over(Window.partitionBy("batch_id", "q_id")))


def _by_sums(sets: DataFrame, rows: DataFrame, predictor, rounds: int, alpha: float, metric_pred: str) -> tuple[DataFrame, DataFrame]:
    own = rows.select(F.col("row_id").alias("p_id"), "y", "z", predictor.prepared("v").alias("v"))
    full = settle(_states(sets).join(own, "p_id"))
    # A lone neighbour stands where a second would.
    demos = full.filter("rank > 1 or most = 1").select("batch_id", F.col("q_id").alias("j"), F.greatest("rank", F.lit(2)).alias("r"), "p_id", "most", F.col("y").alias("demo_y"), F.col("v").alias("demo_v"))
    valid = full.filter("rank = 1").select("batch_id", F.col("q_id").alias("t"), "y", "z", "v")
    along = Window.partitionBy("batch_id", "j", "t").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    votes = demos.join(valid, "batch_id").select("batch_id", "j", "r", "most", "t", "y", "z", predictor.vote("v", "demo_v", "demo_y").alias("vote"))
    sums = settle(votes.withColumn("vote", F.sum("vote").over(along)))
    yhat = F.when(F.round("vote", 9) > 0, 1).otherwise(0)
    error = F.round(combined_error(alpha, metric_pred), 9)

    errs = evaluate(sums.withColumn("yhat", yhat), ["batch_id", "j", "r", "most"]).select("batch_id", "j", "r", "most", error.alias("err"))
    by_set = errs.groupBy("batch_id", "j").agg(F.max("most").alias("most"), F.transform(F.array_sort(F.collect_list(F.struct("r", "err"))), lambda x: x["err"]).alias("errs"))
    batches = by_set.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("j", "most", "errs"))).alias("sets"))
    set_of = lambda i: F.element_at("sets", i + 1)
    begin = F.struct(F.transform("sets", lambda s: F.lit(2)).alias("upto"), F.array().cast("array<struct<round:int,weakest:int,upto:array<int>>>").alias("path"))

    def step(state, i):
        upto = state["upto"]
        weakest = F.array_max(F.transform(upto, lambda u, n: F.struct(F.element_at(set_of(n)["errs"], u - 1).alias("err"), (-n).alias("neg"))))["neg"] * -1
        grown = F.transform(upto, lambda u, n: F.when((n == weakest) & (u < set_of(n)["most"]), u + 1).otherwise(u))
        return F.struct(grown.alias("upto"), F.concat(state["path"], F.array(F.struct(i.alias("round"), weakest.alias("weakest"), upto.alias("upto")))).alias("path"))

    paths = batches.select("batch_id", F.transform("sets", lambda s: s["j"]).alias("js"), F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step, lambda s: s["path"])).alias("at"))
    paths = settle(paths.select("batch_id", "js", "at.round", F.element_at("js", F.col("at.weakest") + 1).alias("weakest"), "at.upto"))
    sizes = paths.select("batch_id", "round", F.explode(F.arrays_zip(F.col("js").alias("j"), F.col("upto").alias("r"))).alias("s")).select("batch_id", "round", "s.j", "s.r")
    union = sums.select("batch_id", "j", "r", "t", "y", "z", "vote").join(sizes, ["batch_id", "j", "r"]).groupBy("batch_id", "round", "t").agg(F.sum("vote").alias("vote"), F.first("y").alias("y"), F.first("z").alias("z"))
    total = evaluate(union.withColumn("yhat", yhat), ["batch_id", "round"]).select("batch_id", "round", error.alias("err"))
    n = F.aggregate("upto", F.lit(0).cast("long"), lambda a, u: a + u - 1)
    trace = settle(total.join(paths.select("batch_id", "round", "weakest", n.alias("n")), ["batch_id", "round"]).select("batch_id", "round", "err", "weakest", "n"))
    chosen = trace.groupBy("batch_id").agg(F.min(F.struct("err", "round"))["round"].alias("round"))
    kept = sizes.join(chosen, ["batch_id", "round"]).select("batch_id", "j", F.col("r").alias("upto"))
    return demos.join(kept, ["batch_id", "j"]).filter("r <= upto").select("batch_id", "p_id"), trace


def _by_rounds(sets: DataFrame, rows: DataFrame, predictor: Predictor, rounds: int, alpha: float, metric_pred: str) -> tuple[DataFrame, DataFrame]:
    sets = settle(sets.select("batch_id", "q_id", "rank", "p_id"))
    valid = validation(sets)
    size = sets.groupBy("batch_id", "q_id").agg(F.max("rank").alias("most"))
    state = settle(size.withColumn("upto", F.lit(2)))
    trace = best = None

    def current(state: DataFrame) -> DataFrame:
        joined = sets.join(state, ["batch_id", "q_id"])
        return joined.filter((F.col("rank").between(2, F.col("upto"))) | ((F.col("most") == 1) & (F.col("rank") == 1))).select("batch_id", "q_id", "p_id")

    states = [state]
    for i in range(1, rounds + 1):
        now = current(state)
        own = _errors(now, valid, rows, predictor, alpha, metric_pred, ["batch_id", "q_id"])
        total = _errors(now.select("batch_id", "p_id"), valid, rows, predictor, alpha, metric_pred, ["batch_id"])
        # A batch has few rows, so its weakest is one max by group.
        weakest = own.groupBy("batch_id").agg((-F.max(F.struct("err", (-F.col("q_id")).alias("neg")))["neg"]).alias("weakest"))
        counts = now.groupBy("batch_id").agg(F.count("*").alias("n"))
        line = settle(total.join(weakest, "batch_id").join(counts, "batch_id").select("batch_id", F.lit(i).alias("round"), "err", "weakest", "n"))
        trace = line if trace is None else trace.unionByName(line)
        grown = (F.col("weakest") == F.col("q_id")) & (F.col("upto") < F.col("most"))
        state = settle(state.join(line.select("batch_id", "weakest"), "batch_id").withColumn("upto", F.when(grown, F.col("upto") + 1).otherwise(F.col("upto"))).drop("weakest"))
        states.append(state)
    first = trace.groupBy("batch_id").agg(F.min(F.struct("err", "round"))["round"].alias("best_round"))
    for i, s in enumerate(states[:-1], 1):
        part = current(s).join(first.filter(F.col("best_round") == i), "batch_id", "left_semi").select("batch_id", "p_id")
        best = part if best is None else best.unionByName(part)
    return best, trace
