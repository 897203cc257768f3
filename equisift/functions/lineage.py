"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a single-JVM session (tests) may do without it; it then gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(sc, "_equisift_own"):
            sc._equisift_own = "file://" + tempfile.mkdtemp(prefix="equisift-")
        where = sc._equisift_own
    return where.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that spark.checkpoint.dir names, where any executor can read it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
