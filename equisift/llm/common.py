"""Shared helpers: the shared folder, cutting lineage, folds, word and shingle hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MASK = (1 << 64) - 1
#: Of a labelled sample's bytes for a class, one text has at most one part of so many; a longer text counts with so many blocks spread over the whole of it.
LARGEST, BLOCKS = 32, 16
#: Bytes of rows that a Python worker gets at once unless the session says otherwise; else 10,000 texts of any length are one batch.
ARROW_BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Only a single-JVM session (tests) may do without it; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(sc, "_equisift_dir"):
            sc._equisift_dir = "file://" + tempfile.mkdtemp(prefix="equisift-")
        found = sc._equisift_dir
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/equisift/{name}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a query when it has ended, instead of when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and every executor can read it. large: its plan shuffled much of the input, so those files go as soon as the table is written; the session's own setting is put back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(FILE_CLEANUP)
    if large:
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if large:
            spark.conf.set(FILE_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._equisift_path = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by cut() that no later step reads."""
    for df in frames:
        if path := getattr(df, "_equisift_path", None):
            delete(df.sparkSession, path)


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)


def in_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of about ARROW_BATCH bytes: a session without spark.sql.execution.arrow.maxBytesPerBatch gets it.

    Spark keeps a worker for later tasks, of other stages too, so a worker gives back what its task has freed.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if rows.sparkSession.conf.get(key, None) is None:
        rows.sparkSession.conf.set(key, str(ARROW_BATCH))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return rows.mapInArrow(task, schema)


def id_crc32(col: str | Column) -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, budget: int, seed: int) -> list:
    """(text, label) of at most `rows` labelled rows of each class 0 and 1 that `keep` admits, in all at most about
    `budget` bytes of text, in an order set by a hash of the id. The bound holds at every input size: the ids are
    limited first, so what is broadcast and collected has at most 2 * rows rows. A text of more than 1 / LARGEST of its
    class's bytes counts with BLOCKS blocks of it, evenly from its first to its last character, so that a few very long texts don't end a class.
    """
    from pyspark.sql import Window

    ids = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter(keep & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y_max")).filter("y = y_max").drop("y_max")
    ids = ids.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    picked = None
    for y in (0, 1):
        part = ids.filter(F.col("y") == y).orderBy("h", "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    share = budget // 2 // LARGEST
    points = F.length("text")
    each = F.floor(points * (share - BLOCKS) / F.octet_length("text") / BLOCKS).cast("int")
    blocks = F.concat_ws("\n", *[F.col("text").substr(F.floor((points - each) * i / (BLOCKS - 1)).cast("int") + 1, each) for i in range(BLOCKS)])
    found = found.withColumn("text", F.when(F.octet_length("text") > share, blocks).otherwise(F.col("text")))
    order = Window.partitionBy("y").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("so_far", F.sum(F.octet_length("text")).over(order)).filter(F.col("so_far") <= budget // 2)
    got = sorted(found.select("h", "doc_id", "text", "y").collect())
    return [(r["text"], r["y"]) for r in got]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, with a bounded memory of words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_A = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(16)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n] * _A[0]
        for i in range(1, k):
            h = mix(h) + words[i : i + n] * _A[i]
        return mix(h + np.uint64(k))


def shingles(text: bytes | None, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles: words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z
    lower-cased; a text with fewer words is one shingle, one without words has none.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words.of(found), min(k, len(found))))


def utf8(column: pa.Array) -> list:
    """The bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of the logistic regression of y (0 or 1) on x, by Newton's steps with a slight ridge; the cases of y = 1 weigh
    as `share` of all, whatever their number."""
    ones = max(float(y.sum()), 1.0)
    v = np.where(y == 1, share / ones, (1 - share) / max(len(y) - ones, 1.0)) * len(y)
    scale = float(x.std()) or 1.0
    z, w, ridge = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (v * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (v * (p - y)) + ridge @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def connected(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): label is the least node that edges (a, b) reach. Both columns are longs.

    Each round takes the least label among neighbours (a pre-aggregated minimum), then halves paths by one lookup
    of the label's own label; rounds are cut in the shared folder. Few rounds are needed, as paths halve.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = cut(nodes.select("node", F.col("node").alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        new = cut(new, f"{name}-round")
        up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new2 = new.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), "old")
        step = cut(new2, f"{name}-labels")
        moved = step.filter("label <> old").limit(1).count()
        forget(new, labels)
        labels = step
        if not moved:
            break
    forget(both)
    out = step.select("node", "label")
    out._equisift_path = step._equisift_path  # so that forget(out) deletes it
    return out
