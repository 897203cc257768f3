"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is its place in that order over the source's size.
Sorting all rows by fractional rank interleaves the sources in proportion, and even cuts of that order give shards of the whole mixture.

No rank needs a source, or the whole table, in one task: both orders are dealt into buckets of some thousand rows (by the seeded hash,
which is uniform, and by the fractional rank, which is uniform by construction), bucket counts are summed up to offsets, and rows are
numbered inside their bucket only. Wholly equal rows have one hash, so they are counted first: a bucket numbers distinct rows, each of which takes as many places as it has copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

#: Rows that a bucket has on average; copies of one row that a task writes out.
BUCKET_ROWS, COPIES = 2048, 1 << 16


def _offsets(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Adds `before`: the rows in earlier buckets of the same `by`."""
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("before", F.sum("n").over(order.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def proportional_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", seed: int = 7) -> DataFrame:
    """One row per input row: id, stratum, size, text_crc32, frac, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 8. Shards' row counts differ by one at most; slots are gapless from 0. A null
    stratum is a stratum of its own. Repeated rows get places of their own. An empty table gives no rows. Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "text_crc32", "size"))
    base = base.withColumn("h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    base = base.groupBy("id", "stratum", "size", "text_crc32", "h").agg(F.count("*").alias("n"))
    base = cut(base.withColumn("u", F.col("h") / F.lit(float(1 << 52))), "shard-rows")
    total = base.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // BUCKET_ROWS)
    rows = base.withColumn("b", F.floor(F.col("u") * buckets))
    sizes = base.groupBy("stratum").agg(F.sum("n").alias("rows"))
    first = _offsets(rows.groupBy("stratum", "b").agg(F.sum("n").alias("n")), ["stratum"], "b").join(sizes.withColumnRenamed("stratum", "s2"), F.col("stratum").eqNullSafe(F.col("s2"))).drop("s2", "n")
    first = first.withColumnsRenamed({"stratum": "s1", "b": "b1"})
    inside = Window.partitionBy("stratum", "b").orderBy("u", "h", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(first, F.col("stratum").eqNullSafe(F.col("s1")) & (F.col("b") == F.col("b1")))
    ranked = ranked.select("id", "stratum", "size", "text_crc32", "h", "n", (F.col("before") + F.col("inside")).alias("at"), "rows")
    # The copies of a row that has very many are written out by several tasks.
    many = ranked.filter(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    many = many.repartition(docs.sparkSession.sparkContext.defaultParallelism).withColumns({"at": F.col("at") + F.col("part") * COPIES, "n": F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES)}).drop("part")
    ranked = ranked.filter(F.col("n") <= COPIES).unionByName(many)
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    frac = (2 * (F.col("at") + F.col("copy")) + 1) / (2.0 * F.col("rows"))
    ranked = ranked.select("id", "stratum", "size", "text_crc32", "h", frac.alias("frac"))
    ranked = cut(ranked.withColumn("b", F.least(F.floor(F.col("frac") * buckets), F.lit(buckets - 1))), "shard-ranks")
    second = _offsets(ranked.groupBy("b").agg(F.count("*").alias("n")), [], "b").select("b", "before")
    inside = Window.partitionBy("b").orderBy("frac", "stratum", "h", "id", "text_crc32", "size")
    placed = ranked.withColumn("inside", F.row_number().over(inside)).join(second, "b").withColumn("pos", F.col("before") + F.col("inside") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(pos * {n_shards} div {max(total, 1)} as int)"))
    slot = F.expr(f"pos - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return placed.select(F.col("id").alias(id_col), F.col("stratum").alias(stratum_col), "size", "text_crc32", "frac", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes docs to path/shard=N, rows of a shard in slot order. Ids must be distinct and not null."""
    out = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_proportional_sharding(spark, sf_dir: str) -> DataFrame:
    placed = proportional_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "frac")


#: DuckDB has no CRC-32: it is stepped over the text's bytes, with a table made by its rule.
ORACLE = """
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, source, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, source, size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(x, '..'), lambda d: ('0x' || d)::BIGINT)),
  lambda a, d: xor(a >> 8, t.crc[1 + (xor(a, d) & 255)])))::BIGINT AS text_crc32 FROM b, t),
h AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, text_crc32::VARCHAR, size::VARCHAR)), 1, 13))::BIGINT AS h FROM c),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS frac FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source, h, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, (pos * 24 // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, pos - (shard::BIGINT * total + 23) // 24 AS slot, NULL::INT AS grown_shard, source, frac FROM s
"""
