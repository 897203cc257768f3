"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text (white space 0x20 and 0x09 to 0x0D deleted; null counts as empty) is cut where its own content says so: at
the first sentence mark after a least length, or at a greatest length. Each distinct chunk's bytes are
moved once, to the chunk store, which proves that an identifier stands for one content. Texts are then compared
by their ordered identifiers; whole texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Least and greatest characters of a chunk, and the marks that end one.
LEAST, MOST, MARKS = 256, 2048, r"[.!?;:|。]"

#: Identifiers (two longs) that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(norm: Column) -> Column:
    """Content-defined chunks, in order; none for the empty text."""
    cuts = F.regexp_extract_all(norm, F.lit(rf"(?s).{{{LEAST},{MOST}}}?{MARKS}|.{{1,{MOST}}}"), F.lit(0))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(cuts)


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("d1"), F.xxhash64(F.lit("second"), chunk).alias("d2"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the most code points in the original, then the least id, stays (ids are of any type that has an order); of wholly equal
    rows one stays; a null id ranks last. Null and empty texts are one group. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    base = base.select("id", F.length("raw").cast("long").alias("points"), normalised(F.col("raw")).alias("norm"))
    slim = cut(
        base.withColumn("parts", chunks(F.col("norm"))).select(
            F.monotonically_increasing_id().alias("rid"), "id", "points", F.sha2("norm", 256).alias("text_sha256"), F.transform("parts", identifier).alias("parts")
        ),
        "dedup-docs", large=True,
    )
    store = base.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(identifier(F.col("chunk")).alias("part"), "chunk")
    # Each distinct chunk goes once to the place of its identifier; one that meets another content there says nothing, and the SHA-256 then decides alone.
    contents = store.groupBy("part.d1", "part.d2", "chunk").agg(F.lit(1).alias("one")).groupBy("d1", "d2").agg(F.count("*").alias("contents"))
    clashes = cut(contents.filter("contents > 1").select("d1", "d2"), "dedup-clashes", large=True)
    rows = slim.select("rid", "id", "points", "text_sha256", F.size("parts").alias("n_chunks"), F.col("parts").alias("recipe"))
    if n := clashes.count():
        side = F.broadcast(clashes) if n <= BROADCAST_ROWS else clashes
        bad = slim.select("rid", F.explode("parts").alias("part")).select("rid", "part.d1", "part.d2").join(side, ["d1", "d2"], "left_semi").select("rid").distinct()
        rows = rows.join(bad.withColumn("bad", F.lit(True)), "rid", "left").withColumn("recipe", F.when(F.col("bad").isNull(), F.col("recipe")).otherwise(F.array().cast(rows.schema["recipe"].dataType))).drop("bad")
    first = F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id", "rid")
    best = rows.groupBy("text_sha256", "recipe").agg(F.min(first).alias("best"), F.count("*").alias("group_size"))
    # Cut, so that the join deals both its sides and Spark can split a group that many rows share.
    best = cut(best.select("text_sha256", "recipe", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"), "dedup-groups")
    return rows.join(best, ["text_sha256", "recipe"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "n_chunks"
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(raw) DESC, doc_id)
"""
