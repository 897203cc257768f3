"""Cleaning a corpus in stages. Each stage works on what the one before kept.

Ids of documents should be distinct. Null texts count as empty ones. Rows with a null id go through all stages but stay in near_dedup, where an id names who stays. Further columns, of any names, are
kept up to the last stage, which keeps them too but for the text and those named like its own (ids, n_tokens, ids_hash, round_trip).

quality: texts that the compression classifier rejects go; exact_dedup: of equal texts one stays; near_dedup: of each component of similar texts the one with
the least id stays; decontamination: texts with a benchmark passage go; tokens: the rest is encoded, and decoded again as a proof; the ids are the product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from equisift.llm import decontamination, exact_dedup, jaccard_join, pieces, quality
from equisift.llm.common import forget, shared_path


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column has (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "quality_score")
    return quality.with_score(docs, model, out_col=score).filter(F.col(score) >= 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # One key of id and text for the join and the window, so that the rows, with their texts, are shuffled once.
    def key(doc_id, sha):
        return F.concat(sha, F.when(doc_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), doc_id.cast("string"))))

    kept = exact_dedup.exact_dedup(docs).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    # The row goes along as one column, so that its names meet no others.
    rows = docs.select(F.struct("*").alias("row"), key(F.col("doc_id"), F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("key"), F.length("text").alias("points"))
    rows = rows.join(kept, "key", "left_semi")
    # Wholly repeated rows are copies too.
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.col("points").desc()))).filter("place = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = jaccard_join.jaccard_components(docs).select(F.col("component_id").alias("stay")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stay")), "left_semi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokens_of(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("tokens", to_tokens)]

#: The classifier, the components and the tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage returns is written to the shared folder, and the next one reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            forget(before)
        docs = before = spark.read.parquet(path)
        docs._equisift_path = path
    return docs
