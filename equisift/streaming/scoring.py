"""An extension: test rows that arrive as a stream are predicted with a fixed set of demonstrations, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.predictors import Predictor


def score_stream(stream: DataFrame, demos: DataFrame, predictor: Predictor, path: str, checkpoint: str) -> StreamingQuery:
    """Appends (batch, row_id, y, z, yhat) to parquet under path. A micro-batch that runs again overwrites its own folder, so its rows are there once."""

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("set_id", F.lit("stream"))
        pred = predictor.predict(rows, demos.withColumn("set_id", F.lit("stream")))
        rows.select("row_id", "y", "z").join(pred, "row_id").drop("set_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
