"""Sampling, splitting and ranks. Draws come from stateless uniforms, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import settle
from ..functions.rng import uniform

#: Buckets that a uniform order is dealt into when a share of a stratum is taken.
BUCKETS = 4096


def stratified_split(df: DataFrame, stratum: str, ratio: float, seed: int, row_id: str = "row_id") -> DataFrame:
    """df with `split`: dev for exactly round(ratio * n) rows of each stratum, else train.

    A stratum is never ranked whole: its rows fall into buckets of the uniform order, buckets before the limit are taken whole, and only
    the rows of the bucket that the limit cuts are ranked.
    """
    rows = df.withColumn("_u", uniform(seed, "split", 0, row_id)).withColumn("_b", F.floor(F.col("_u") * BUCKETS))
    order = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_upto": F.sum("_n").over(order), "_k": F.round(F.sum("_n").over(Window.partitionBy(stratum)) * ratio)})
    limits = counts.select(F.col(stratum).alias("_s"), F.col("_b").alias("_b2"), (F.col("_k") - (F.col("_upto") - F.col("_n"))).alias("_left"), "_n")
    rows = rows.join(limits, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2")))
    inside = Window.partitionBy(stratum, "_b").orderBy("_u", row_id)
    taken = F.when(F.col("_left") <= 0, False).when(F.col("_left") >= F.col("_n"), True).otherwise(F.row_number().over(inside) <= F.col("_left"))
    return rows.withColumn("split", F.when(taken, "dev").otherwise("train")).drop("_u", "_b", "_s", "_b2", "_left", "_n")


def sample(df: DataFrame, n: int, seed: int, tag: str = "sample", row_id: str = "row_id") -> DataFrame:
    """n rows, each set of n as likely; all rows if there are no more. A top-n by a uniform: no full sort."""
    return df.withColumn("_u", uniform(seed, tag, 0, row_id)).orderBy("_u", row_id).limit(n).drop("_u")


def head(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id).limit(n)


def roulette(df: DataFrame, by: str | list[str], k: int, seed: int, round_: int, score: str = "score", row_id: str = "row_id") -> DataFrame:
    """k rows of each cell without replacement, drawn in proportion to score (least -ln(u) / score); rows without a positive score come last, by id.

    The rank is limited by a constant, so every task keeps k rows of a cell at most before the shuffle.
    """
    weight = F.col(score)
    key = F.when(weight > 0, -F.log(uniform(seed, "roulette", round_, row_id)) / weight)
    order = Window.partitionBy(by).orderBy(F.col("_key").asc_nulls_last(), row_id)
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_key", "_r")


def top_k(df: DataFrame, by: str | list[str], k: int, score: str = "score", row_id: str = "row_id") -> DataFrame:
    """The k rows of each cell with the greatest score (ties by id), with `rank`; none for k = 0."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), row_id)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def global_rank(df: DataFrame, order: str | Column, name: str = "pos") -> DataFrame:
    """df with each row's place from 0 in the order. Rows are range-partitioned and numbered in their partition; only the partitions' counts are summed in one place."""
    parts = settle(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    rows = parts.withColumn("_part", part).join(before, "_part")
    return rows.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def batch_ids(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with batch_id: contiguous runs of `size` rows in the order; the last may be short."""
    return global_rank(df, order, "_pos").withColumn("batch_id", F.floor(F.col("_pos") / size)).drop("_pos")


def first_of_each(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys without white space (of any kind) and quotes around them, each with the least pos it came at; empty ones go."""
    bare = F.regexp_replace(F.regexp_replace(F.col(key), r"(?U)^\s+|\s+$", ""), "^\"+|\"+$", "")
    bare = F.regexp_replace(bare, "^'+|'+$", "")
    return df.select(bare.alias("key"), F.col(pos).alias("pos"), F.col(key).alias("_raw")).filter("_raw is not null and _raw <> ''").groupBy("key").agg(F.min("pos").alias("pos"))
