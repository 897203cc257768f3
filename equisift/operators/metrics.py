"""Performance and group fairness of predictions: one aggregation pass, all sums conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-10
PERFORMANCE = ("accuracy", "precision", "recall", "f1_score")
FAIRNESS = ("DP_0", "DP_1", "delta_dp", "ratio_dp", "TPR_0", "TPR_1", "FPR_0", "FPR_1", "delta_eo", "ratio_eo")
ALL = PERFORMANCE + FAIRNESS


def _counts(y: Column, yhat: Column, z: Column) -> dict[str, Column]:
    one = yhat == 1
    out = {"n": F.count("*"), "hit": F.count_if(y == yhat), "tp": F.count_if((y == 1) & one), "fp": F.count_if((y != 1) & one), "fn": F.count_if((y == 1) & ~one)}
    for g in (0, 1):
        m = z == g
        out |= {f"n{g}": F.count_if(m), f"s{g}": F.sum(F.when(m, yhat).otherwise(0))}
        for v in (0, 1):
            out |= {f"n{g}{v}": F.count_if(m & (y == v)), f"s{g}{v}": F.sum(F.when(m & (y == v), yhat).otherwise(0))}
    return out


def _share(a: str, b: str) -> Column:
    """a / b, 0 where there is nothing to divide by."""
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def evaluate(pred: DataFrame, by: list[str] | tuple[str, ...] = (), y: str = "y", yhat: str = "yhat", z: str = "z") -> DataFrame:
    """The 14 metrics of predictions, one row for each group of `by`.

    Rates over no rows are 0, not null. Ratios have 1e-10 added to the divisor and no cap.
    """
    counts = _counts(F.col(y), F.col(yhat), F.col(z))
    agg = pred.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in counts.items()])
    rows = agg.select(
        *by, _share("_hit", "_n").alias("accuracy"), F.when(F.col("_tp") + F.col("_fp") > 0, F.col("_tp") / (F.col("_tp") + F.col("_fp"))).otherwise(0.0).alias("precision"),
        F.when(F.col("_tp") + F.col("_fn") > 0, F.col("_tp") / (F.col("_tp") + F.col("_fn"))).otherwise(0.0).alias("recall"),
        F.when(2 * F.col("_tp") + F.col("_fp") + F.col("_fn") > 0, 2 * F.col("_tp") / (2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))).otherwise(0.0).alias("f1_score"),
        _share("_s0", "_n0").alias("DP_0"), _share("_s1", "_n1").alias("DP_1"),
        _share("_s01", "_n01").alias("TPR_0"), _share("_s11", "_n11").alias("TPR_1"), _share("_s00", "_n00").alias("FPR_0"), _share("_s10", "_n10").alias("FPR_1"),
    )
    c = F.col
    rows = rows.withColumns(
        {
            "delta_dp": F.abs(c("DP_1") - c("DP_0")), "ratio_dp": c("DP_0") / (c("DP_1") + EPS),
            "delta_eo": F.greatest(F.abs(c("TPR_1") - c("TPR_0")), F.abs(c("FPR_1") - c("FPR_0"))),
            "ratio_eo": F.least(c("TPR_0") / (c("TPR_1") + EPS), c("FPR_0") / (c("FPR_1") + EPS)),
        }
    )
    return rows.select(*by, *ALL)


def performance(pred: DataFrame, by=()) -> DataFrame:
    return evaluate(pred, by).select(*by, *PERFORMANCE)


def demographic_parity(pred: DataFrame, by=()) -> DataFrame:
    return evaluate(pred, by).select(*by, "DP_0", "DP_1", "delta_dp", "ratio_dp")


def equalized_odds(pred: DataFrame, by=()) -> DataFrame:
    return evaluate(pred, by).select(*by, "TPR_0", "TPR_1", "FPR_0", "FPR_1", "delta_eo", "ratio_eo")


def combined_error(alpha: float, metric_pred: str = "f1_score") -> Column:
    """alpha (1 - metric) + (1 - alpha) |DP_0 - DP_1|, over a row of metrics. Its fairness part is always demographic parity."""
    return alpha * (1 - F.col(metric_pred)) + (1 - alpha) * F.abs(F.col("DP_0") - F.col("DP_1"))


def evolution_score(icl: str, base: str, alpha: float, floor: float, metric_pred: str, metric_fair: str, lower_is_better: bool = False) -> Column:
    """alpha max(gain in performance, floor) + (1 - alpha) max(gain in fairness, floor); icl and base are prefixes of metric columns.

    A gain is icl - base for any metric; lower_is_better turns it round for differences, where less is fairer.
    """
    fair = F.col(icl + metric_fair) - F.col(base + metric_fair)
    return alpha * F.greatest(F.col(icl + metric_pred) - F.col(base + metric_pred), F.lit(floor)) + (1 - alpha) * F.greatest(-fair if lower_is_better else fair, F.lit(floor))


def long_form(rows: DataFrame, by: list[str] | tuple[str, ...] = (), names: tuple[str, ...] = ALL) -> DataFrame:
    """(by, metric, value)."""
    return rows.unpivot(list(by), list(names), "metric", "value")


def rounded(rows: DataFrame, names: tuple[str, ...], digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in names})
