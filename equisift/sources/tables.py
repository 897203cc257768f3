"""Sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import SelectionConfig
from ..operators import encoding, reports
from .ledger import published_once

# The columns of the headerless census files, in order, and those left out.
CENSUS = (
    "age int, workclass string, fnlwgt int, education string, education_num int, marital_status string, occupation string, relationship string, race string, sex string, "
    "capital_gain int, capital_loss int, hours_per_week int, native_country string, income string"
)
CENSUS_DROP = ("fnlwgt", "education_num", "race", "native_country")
CENSUS_TEXT = ("workclass", "education", "marital_status", "occupation", "relationship", "sex", "income")


def read_csv(spark: SparkSession, path: str, schema: str = CENSUS) -> DataFrame:
    """A headerless CSV with blanks after its commas, by an explicit schema; row_id counts the rows from 0 by file name and place in the file, however Spark splits the files."""
    rows = spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = rows.columns
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    # One row for each split; the window over these counts them, not the rows.
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.select("_file", "_start", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    return rows.join(splits, ["_file", "_start"]).select(*names, (F.col("_before") + F.col("_at") - F.col("_first")).alias("row_id"))


def census(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both files, cleaned, with a `part` column; codes are fitted on the training file and applied to both. A dot at the end of an income is no part of it."""
    parts = [encoding.clean(read_csv(spark, p), CENSUS_DROP).withColumn("income", F.rtrim("income", F.lit("."))) for p in (train, test)]
    coded = [encoding.encode(p, list(CENSUS_TEXT), fit=parts[0]).withColumn("part", F.lit(name)) for p, name in zip(parts, ("train", "test"))]
    return coded[0].unionByName(coded[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(df: DataFrame) -> str:
    """A key of a table's rows, in whatever order and partitions: their number, and two sums of 64-bit hashes without carry, of single rows and of rows with their counts."""
    n, a, b = df.select(F.xxhash64(F.lit(1), "*").alias("a"), F.xxhash64(F.lit(2), "*").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).agg(
        F.sum("n"), F.bit_xor(F.xxhash64("a", "n")), F.bit_xor(F.xxhash64("b", "n"))
    ).first()
    return f"{n or 0}-{(a or 0) % (1 << 64):016x}{(b or 0) % (1 << 64):016x}"


def cached(spark: SparkSession, folder: str, name: str, config: SelectionConfig, make, source: DataFrame | None = None) -> DataFrame:
    """A table kept between runs under a key of its parameters and of the rows of `source`, what it is made from: other parameters or rows never meet an old file. It counts once a manifest names it, so a run that ends
    while it writes leaves nothing that a later one reads."""
    return published_once(spark, folder, f"{name}-{config.key()}" + (f"-{content_key(source)}" if source is not None else ""), make)


#: A run's results, as they are kept.
RESULTS = "type string, method string, metric string, value string, run string"


def write_results(metrics: DataFrame, folder: str, run: str | None = None, config: SelectionConfig | None = None) -> str:
    """A run's parameters and results as CSV with a header (type, method, metric, value) under folder/run=<run>; the run's name, made of the time where none is given. Other runs stay; writing a run again replaces it."""
    from dataclasses import asdict

    run = run or f"results_{datetime.now():%Y%m%d_%H%M%S}"
    rows = reports.results(metrics, asdict(config) if config else None).withColumn("run", F.lit(run))
    rows.drop("value_num").write.partitionBy("run").mode("overwrite").option("partitionOverwriteMode", "dynamic").csv(folder, header=True)
    return run


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(run, type, method, metric, value, value_num) of all runs; a filter on run reads its files only. value_num is null where value is no number."""
    rows = spark.read.schema(RESULTS).csv(folder, header=True)
    return rows.select("run", "type", "method", "metric", "value", F.expr("try_cast(value AS double)").alias("value_num"))


def write_report(metrics: DataFrame, path: str) -> None:
    """The results as lines of text."""
    reports.as_text(metrics).orderBy("method", "line_no").select("line").write.mode("overwrite").text(path)
