"""The two phases as one object: a fair pool of demonstrations, then per-batch refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SelectionConfig
from ..functions.lineage import settle
from ..operators import adaptive, clustering, encoding, evolution, metrics, neighbors, sampling
from ..operators.predictors import Predictor, Rule, SimilarityVote


class FairSelector:
    """rows: (row_id, y, z, v); further columns are carried along. Nothing is collected to the driver."""

    def __init__(self, config: SelectionConfig = SelectionConfig(), predictor: Predictor | None = None, zero_shot: Predictor | None = None):
        self.config = config
        self.predictor = predictor or SimilarityVote()
        self.zero_shot = zero_shot or Rule("false")
        self.train = self.dev = self.scored = self.pool = None

    def load(self, rows: DataFrame) -> "FairSelector":
        c = self.config
        rows = encoding.cells(rows.withColumnsRenamed({c.label: "y", c.sensitive: "z"}))
        split = sampling.stratified_split(rows, "y", c.dev_ratio, c.seed)
        self.train = settle(split.filter("split = 'train'").drop("split"))
        self.dev = settle(sampling.sample(split.filter("split = 'dev'").drop("split"), c.max_dev_samples, c.seed, "dev"))
        return self

    def represent(self) -> DataFrame:
        """The representatives of each cell, with the score that evolution begins with."""
        c = self.config
        centroids = clustering.lloyd(self.train, c.n_clusters, c.lloyd_rounds, c.seed, c.lloyd_starts, c.seeding)
        picked = clustering.representatives(self.train, centroids, c.n_clusters, c.m_neighbors)
        return settle(picked.select("sg", "row_id", "y", "z", "v", F.lit(c.floor).alias("score")))

    def evolve(self, scored: DataFrame, metric_fair: str | tuple[str, ...]) -> DataFrame:
        c = self.config
        return evolution.evolve(scored, self.dev, self.predictor, c.iterations, c.k_shots, c.seed, c.alpha, c.floor, c.metric_pred, metric_fair, self.zero_shot)

    def fit(self) -> "FairSelector":
        self.scored = self.evolve(self.represent(), self.config.metric_fair)
        return self

    def select_demonstrations(self, k: int | None = None) -> DataFrame:
        self.pool = settle(sampling.top_k(self.scored, "sg", self.config.k_shots if k is None else k))
        return self.pool

    def _test(self, test: DataFrame) -> DataFrame:
        c = self.config
        return sampling.head(test.withColumnsRenamed({c.label: "y", c.sensitive: "z"}), c.max_test_samples)

    def evaluate(self, test: DataFrame) -> DataFrame:
        """(method, 14 metrics): without demonstrations and with the pool."""
        rows = settle(self._test(test).withColumn("set_id", F.lit("all")))
        found = {"zero_shot": self.zero_shot.predict(rows, None), "few_shot": self.predictor.predict(rows, self.pool.withColumn("set_id", F.lit("all")))}
        out = None
        for method, pred in found.items():
            part = metrics.evaluate(rows.select("row_id", "y", "z").join(pred, "row_id").withColumn("method", F.lit(method)), ["method"])
            out = part if out is None else out.unionByName(part)
        return out

    def evaluate_adaptive(self, test: DataFrame, with_pool: bool = True) -> DataFrame:
        """(method, 14 metrics): with demonstrations refined for each batch, and with the pool as it is."""
        c = self.config
        rows = settle(sampling.batch_ids(self._test(test), "row_id", c.batch_size))
        near = neighbors.nearest(rows, self.pool, c.k_neighbors)
        sets = settle(neighbors.support(near, rows.select(F.col("row_id").alias("q_id"), "batch_id")))
        best, _ = adaptive.search(sets, self.pool.select("row_id", "y", "z", "v"), self.predictor, c.search_rounds, c.alpha, c.metric_pred)
        demos = best.join(self.pool.withColumnRenamed("row_id", "p_id"), "p_id").withColumn("set_id", F.col("batch_id").cast("string")).withColumnRenamed("p_id", "row_id")
        pred = {"adaptive": self.predictor.predict(rows.withColumn("set_id", F.col("batch_id").cast("string")), demos)}
        if with_pool:
            pred["few_shot"] = self.predictor.predict(rows.withColumn("set_id", F.lit("all")), self.pool.withColumn("set_id", F.lit("all")))
        out = None
        for method, p in pred.items():
            part = metrics.evaluate(rows.select("row_id", "y", "z").join(p, "row_id").withColumn("method", F.lit(method)), ["method"])
            out = part if out is None else out.unionByName(part)
        return out


def run_selection(train: DataFrame, test: DataFrame, config: SelectionConfig = SelectionConfig(), adaptive_search: bool = True) -> DataFrame:
    """Both phases; (method, 14 metrics)."""
    s = FairSelector(config).load(train).fit()
    s.select_demonstrations()
    out = s.evaluate(test)
    return out.unionByName(s.evaluate_adaptive(test, with_pool=False)) if adaptive_search else out


def few_shot_by_metric(scored: DataFrame, test: DataFrame, k: int, predictor: Predictor) -> DataFrame:
    """(metric_fair, 14 metrics) of predictions for test (row_id, y, z, v) with the k best rows of each cell, for each metric that scored (metric_fair, sg, row_id, y, v, score) has. All are predicted in one job."""
    pool = settle(sampling.top_k(scored, ["metric_fair", "sg"], k).withColumn("set_id", F.col("metric_fair")))
    # One row for each metric.
    rows = test.join(F.broadcast(pool.select("set_id").distinct()))
    pred = rows.select("set_id", "row_id", "y", "z").join(predictor.predict(rows, pool), ["set_id", "row_id"])
    return metrics.evaluate(pred.withColumnRenamed("set_id", "metric_fair"), ["metric_fair"])


def sweep(train: DataFrame, test: DataFrame, fair_metrics: list[str], config: SelectionConfig = SelectionConfig(), predictor: Predictor | None = None) -> DataFrame:
    """Phase one for each fairness metric; (metric_fair, method, 14 metrics).

    Loading, clustering and the prediction without demonstrations don't hang on the metric and are made once; draws, scores and predictions of all metrics are the same jobs, keyed by metric and cell.
    """
    s = FairSelector(config, predictor).load(train)
    scored = s.evolve(s.represent(), tuple(fair_metrics))
    rows = settle(s._test(test).withColumn("set_id", F.lit("all")))
    few = few_shot_by_metric(scored, rows.drop("set_id"), config.k_shots, s.predictor).withColumn("method", F.lit("few_shot"))
    zero = metrics.evaluate(rows.select("row_id", "y", "z").join(s.zero_shot.predict(rows, None), "row_id"))
    zero = zero.withColumns({"metric_fair": F.explode(F.array(*[F.lit(m) for m in fair_metrics])), "method": F.lit("zero_shot")})
    return few.unionByName(zero).select("metric_fair", "method", *metrics.ALL)
