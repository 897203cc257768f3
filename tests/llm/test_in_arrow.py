import pyarrow as pa
from pyspark.sql import functions as F

from equisift.llm.common import ARROW_BATCH, in_arrow

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _batches(texts):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    return texts.transform(in_arrow, run, "n bigint, size bigint").collect()


def test_batches_are_bounded_and_all_rows_come(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    try:
        texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
        got = _batches(texts)
        assert spark.conf.get(KEY) == str(ARROW_BATCH)
        assert sum(r["n"] for r in got) == 3000
        # A batch ends with the row that reaches the bound.
        assert max(r["size"] for r in got) < 1.1 * ARROW_BATCH
    finally:
        spark.conf.set(KEY, before) if before is not None else spark.conf.unset(KEY)


def test_a_sessions_own_value_stays(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.set(KEY, str(1 << 20))
    try:
        assert sum(r["n"] for r in _batches(spark.range(10).select(F.lit("a").alias("text")))) == 10
        assert spark.conf.get(KEY) == str(1 << 20)
    finally:
        spark.conf.set(KEY, before) if before is not None else spark.conf.unset(KEY)


def test_no_rows(spark):
    assert _batches(spark.range(0).select(F.lit("a").alias("text"))) == []
