"""Reports: long results, statistics of scores and demonstrations, improvements, and pivots over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .metrics import ALL, long_form


def results(metrics: DataFrame, config: dict | None = None) -> DataFrame:
    """(type, method, metric, value, value_num): a run's parameters, then its metrics. metrics has a `method` column."""
    rows = long_form(metrics, ["method"]).select(F.lit("evaluation").alias("type"), "method", "metric", F.col("value").cast("string").alias("value"), F.col("value").alias("value_num"))
    if not config:
        return rows
    own = [("config", str(k), "config_value", str(v), float(v) if isinstance(v, (int, float)) else None) for k, v in config.items()]
    return metrics.sparkSession.createDataFrame(own, rows.schema).unionByName(rows)


def score_stats(scored: DataFrame, by: str = "sg", score: str = "score") -> DataFrame:
    """Mean, population deviation, least and greatest score of each cell."""
    return scored.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))


def score_extremes(scored: DataFrame, by: str = "sg", score: str = "score", n: int = 3) -> DataFrame:
    """(by, kind, rank, score): the n greatest ('top') and n least ('bottom') scores of each cell, ties each with a rank of their own; null scores are left out."""
    rows = scored.filter(F.col(score).isNotNull()).select(by, F.col(score).alias("score"))
    ranked = lambda kind, order: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("rank") <= n).select(by, F.lit(kind).alias("kind"), "rank", "score")
    return ranked("top", F.desc("score")).unionByName(ranked("bottom", F.asc("score")))


def demo_stats(demos: DataFrame, value: str, z: str = "z", y: str = "y") -> DataFrame:
    """Counts by z and y, and mean, sample deviation, least and greatest of a column."""
    return demos.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in (z, y) for v in (0, 1)],
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


def improvements(metrics: DataFrame, old: str, new: str) -> DataFrame:
    """One row: new - old for accuracy, f1_score and ratio_eo; old - new for delta_eo, where less is better. metrics has a `method` column."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    gain = {c: pick(new, c) - pick(old, c) for c in ("accuracy", "f1_score", "ratio_eo")} | {"delta_eo": pick(old, "delta_eo") - pick(new, "delta_eo")}
    return metrics.agg(*[v.alias(f"gain_{k}") for k, v in gain.items()])


def across_runs(long: DataFrame, metric: str, methods: list[str]) -> DataFrame:
    """One row for each run, a column for each method. long: (run, method, metric, value)."""
    return long.filter(F.col("metric") == metric).groupBy("run").pivot("method", methods).agg(F.first("value"))


def as_text(metrics: DataFrame) -> DataFrame:
    """(method, line_no, line): the report of each method as lines of text."""
    names = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1_score": "F1-Score"}
    lines = [F.concat(F.upper("method"), F.lit(" RESULTS"))]
    lines += [F.concat(F.lit(f"  {names.get(c, c)}: "), F.format_string("%.4f", F.col(c))) for c in ALL]
    return metrics.select("method", F.posexplode(F.array(*lines)).alias("line_no", "line"))


def print_report(metrics: DataFrame) -> None:
    """The report of each method on the console: some lines for each, however many rows were predicted."""
    for r in as_text(metrics).orderBy("method", "line_no").collect():
        print(r["line"])
