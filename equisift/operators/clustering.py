"""Diverse representatives: K-means in all cells at once, then the members nearest to each centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rng import uniform
from ..functions.vectors import distance
from . import kmeans

DIGITS = 9


def first_centroids(rows: DataFrame, k: int, seed: int, start: int = 0) -> DataFrame:
    """(sg, cluster, c): k rows of each cell in the order of a uniform of this start; a cell of fewer rows has fewer clusters."""
    order = Window.partitionBy("sg").orderBy("_u", "row_id")
    picked = rows.withColumn("_u", uniform(seed, "kmeans", start)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return picked.select("sg", (F.col("_r") - 1).alias("cluster"), F.col("v").alias("c"))


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """rows with cluster and dist of the nearest centroid of their cell. A cell's centroids (k at most) come as one array, so rows aren't multiplied or shuffled where the arrays are broadcast."""
    table = centroids.groupBy("sg").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("_cs"))
    near = F.array_min(F.transform("_cs", lambda s: F.struct(F.round(distance("v", s["c"]), DIGITS).alias("dist"), s["cluster"].alias("cluster"))))
    return rows.join(table, "sg").withColumn("_near", near).withColumns({"cluster": F.col("_near.cluster"), "dist": F.col("_near.dist")}).drop("_cs", "_near")


def lloyd(rows: DataFrame, k: int, rounds: int, seed: int, starts: int = 1, seeding: str = "uniform") -> DataFrame:
    """(sg, cluster, c): centroids once none moves, or after so many rounds; of several starts each cell keeps the one with the least sum of squared distances (ties: the first). seeding: uniform, or parallel for
    k-means||."""
    if seeding not in ("uniform", "parallel"):
        raise ValueError("seeding is uniform or parallel")
    seeds = kmeans.uniform_seeds(rows, k, seed, starts) if seeding == "uniform" else kmeans.parallel_seeds(rows, k, seed, starts)
    centres, cost = kmeans.run(rows, seeds, rounds)
    best = kmeans.best_starts(cost)
    found = [(name, i, c.tolist()) for name, s in best.items() for i, c in enumerate(centres[name][s])]
    return rows.sparkSession.createDataFrame(found, "sg string, cluster int, c array<double>")


def representatives(rows: DataFrame, centroids: DataFrame, n_clusters: int, m: int) -> DataFrame:
    """rows picked: of each cluster the m members nearest to its centroid, then, up to min(n_clusters * m, size of the cell), the rows nearest to any centroid.

    Ties go by id. m = 0 picks none. Ranks are limited by constants, so each task sends few rows of a cell.
    """
    target = n_clusters * m
    near = assign(rows, centroids)
    own = Window.partitionBy("sg", "cluster").orderBy("dist", "row_id")
    rest = Window.partitionBy("sg").orderBy("dist", "row_id")
    # Of one cell's rows, those that can be picked are among the first m of a cluster or the first `target` of the cell.
    first = near.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= m).drop("_r").withColumn("own", F.lit(1))
    fill = near.withColumn("_r", F.row_number().over(rest)).filter(F.col("_r") <= target).drop("_r").withColumn("own", F.lit(0))
    both = first.unionByName(fill).withColumn("_first", F.max("own").over(Window.partitionBy("sg", "row_id"))).filter("own = _first").drop("own")
    order = Window.partitionBy("sg").orderBy(F.col("_first").desc(), "dist", "row_id")
    return both.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= target).drop("_r").withColumnRenamed("_first", "in_cluster")
