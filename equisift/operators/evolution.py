"""Scores evolved by repeated weighted draws: a draw's gain over the baseline moves the scores of the rows drawn.

The state is a log: (round, row, e) of the rows drawn, k of each cell and round. A row's score is its first one folded with its lines of the log, so no table is written again, and vectors move only for rows drawn.
Several fairness metrics evolve side by side, as a part of the key of draws, scores and gains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import settle
from .metrics import ALL, evaluate, evolution_score
from .predictors import Predictor
from .sampling import roulette


def baseline(dev: DataFrame, predictor: Predictor) -> DataFrame:
    """One row of metrics, named base_*, of predictions without demonstrations; computed once for all cells and rounds."""
    pred = predictor.predict(dev.withColumn("set_id", F.lit("base")), None)
    rows = evaluate(dev.select("row_id", "y", "z").join(pred, "row_id"))
    return rows.select(*[F.col(c).alias(f"base_{c}") for c in ALL])


SETS = ("g00", "g01", "g10", "g11")


def draw_scores(drawn: DataFrame, dev: DataFrame, base: DataFrame, predictor: Predictor, alpha: float, floor: float, metric_pred: str, metric_fair: tuple[str, ...]) -> DataFrame:
    """(metric_fair, sg, e): the gain of each metric's and cell's draw over the baseline on the development rows. All are predicted in one job."""
    demos = drawn.withColumn("set_id", F.concat_ws("/", "metric_fair", "sg"))
    test = dev.withColumn("set_id", F.explode(F.array(*[F.lit(f"{m}/{s}") for m in metric_fair for s in SETS])))
    pred = predictor.predict(test, demos).join(dev.select("row_id", "y", "z"), "row_id")
    icl = evaluate(pred, ["set_id"]).select(F.split("set_id", "/")[0].alias("metric_fair"), F.split("set_id", "/")[1].alias("sg"), *[F.col(c).alias(f"icl_{c}") for c in ALL])
    e = F.coalesce(*[F.when(F.col("metric_fair") == m, evolution_score("icl_", "base_", alpha, floor, metric_pred, m)) for m in metric_fair])
    # The baseline is one row.
    return icl.join(F.broadcast(base)).select("metric_fair", "sg", F.round(e, 9).alias("e"))


def with_log(scored: DataFrame, log: DataFrame | None) -> DataFrame:
    """scored with the scores that the log's lines make of them, in order of rounds: s becomes (s + e) / 2."""
    if log is None:
        return scored
    lines = log.groupBy("metric_fair", "sg", "row_id").agg(F.array_sort(F.collect_list(F.struct("round", "e"))).alias("_lines"))
    # k rows of each metric, cell and round at most, however many rows there are.
    moved = scored.join(F.broadcast(lines), ["metric_fair", "sg", "row_id"], "left")
    fold = F.aggregate("_lines", F.col("score").cast("double"), lambda s, x: (s + x["e"]) / 2)
    return moved.withColumn("score", F.when(F.col("_lines").isNotNull(), fold).otherwise(F.col("score"))).drop("_lines")


def evolve(
    scored: DataFrame, dev: DataFrame, predictor: Predictor, rounds: int, k: int, seed: int, alpha: float = 0.5, floor: float = 0.05, metric_pred: str = "f1_score", metric_fair: str | tuple[str, ...] = "ratio_eo",
    zero_shot: Predictor | None = None,
) -> DataFrame:
    """scored (sg, row_id, y, v, score) with the score after `rounds` rounds. With a tuple of fairness metrics, rows are there for each, told apart by `metric_fair`; a metric's scores are those that it has alone."""
    several = (metric_fair,) if isinstance(metric_fair, str) else tuple(metric_fair)
    rows = scored.withColumn("metric_fair", F.explode(F.array(*[F.lit(m) for m in several])))
    base, log = settle(baseline(dev, zero_shot or predictor)), None
    slim = rows.select("metric_fair", "sg", "row_id", "score")
    for i in range(1, rounds + 1):
        drawn = roulette(with_log(slim, log), ["metric_fair", "sg"], k, seed, i).select("metric_fair", "sg", "row_id")
        drawn = settle(scored.select("sg", "row_id", "y", "v").join(F.broadcast(drawn), ["sg", "row_id"]))
        e = draw_scores(drawn, dev, base, predictor, alpha, floor, metric_pred, several)
        line = settle(drawn.select("metric_fair", "sg", "row_id").join(e, ["metric_fair", "sg"]).withColumn("round", F.lit(i)))
        log = line if log is None else log.unionByName(line)
    out = with_log(rows, log)
    return out.drop("metric_fair") if isinstance(metric_fair, str) else out
