"""A store of embeddings by content: a row for each distinct text and model, kept between runs. One new text costs one embedding, not the table's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lineage import settle
from .ledger import Ledger

#: Folders that keys are dealt to.
BUCKETS = 64


class EmbeddingStore:
    """embed(df with `key` and `text`) adds `v`, array<double>, null where a text could not be embedded; such texts aren't stored, so the next run tries them again.

    Keys are SHA-256 of model and text, so another model or wording never meets an old vector. A new batch of vectors is published whole or not at all; two runs that embed one text at one time store it twice, and readers
    take one of the two.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str, embed: Callable[[DataFrame], DataFrame], dim: int, buckets: int = BUCKETS):
        self.model, self.embed, self.dim, self.buckets = model, embed, dim, buckets
        self.ledger = Ledger(spark, folder, "key string, v array<double>, bucket int", ("bucket",))

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.model), F.lit("\n"), text), 256)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def add(self, texts: DataFrame, text: str = "text") -> int:
        """Embeds what is not stored yet; how many vectors were added. Keys meet the stored keys first, bucket by bucket; texts move only where theirs is missing."""
        wanted = texts.select(F.col(text).alias("text")).filter("text is not null").withColumn("key", self.key(F.col("text")))
        keys = wanted.select("key").distinct().withColumn("bucket", self._bucket())
        missing = settle(keys.join(self.ledger.read().select("bucket", "key"), ["bucket", "key"], "left_anti").select("key"))
        made = self.embed(wanted.join(missing, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
        made = settle(made.filter("v is not null").select("key", "v").withColumn("bucket", self._bucket()))  # asked for once
        n = made.count()
        if n:
            self.ledger.append(made)
        return n

    def vectors(self) -> DataFrame:
        """(key, v, bucket), a row for each key."""
        return self.ledger.read().groupBy("bucket", "key").agg(F.min("v").alias("v"))

    def embedded(self, rows: DataFrame, text: str = "text", out: str = "v") -> DataFrame:
        """rows with their vector, after what is missing has been added; a zero vector where a text is null or could not be embedded."""
        self.add(rows, text)
        stored = self.vectors().select(F.col("key").alias("_key"), F.col("v").alias(out))
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return rows.drop(out).withColumn("_key", self.key(F.col(text))).join(stored, "_key", "left").drop("_key").withColumn(out, F.coalesce(out, zero))
