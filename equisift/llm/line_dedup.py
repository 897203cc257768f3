"""Line deduplication by winnowing over line hashes.

The hashes of a text's lines (blank lines aside) are winnowed: every window of RUN_LINES lines gives its least hash as a fingerprint, and a line of
LONG_WORDS words or more is a fingerprint by itself, so every run that counts holds one. Fingerprints found once in the corpus end there;
the others carry their neighbours' hashes (128 bits a line: lines with equal hashes count as equal), and a match is extended over them both ways: window by window, which covers a run of any length.
Of equal runs the first in (id, line) order stays; every later one is deleted.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, forget, in_arrow, utf8

#: A repeated run counts from so many lines on; a line of so many words is a run by itself.
RUN_LINES, LONG_WORDS = 3, 8
_MASK = (1 << 64) - 1
_BLANK = b" \t\r\x0b\x0c"


def fingerprints(text: bytes, run_lines: int, long_words: int):
    """(hash, position, long, place among, hashes of and numbers of the lines up to run_lines - 1 before and after) of the selected lines.
    Positions count lines that aren't blank. A line has two hashes of 64 bits, one after the other; the first selects."""
    lines = [(i, s) for i, x in enumerate(text.split(b"\n")) if (s := x.strip(_BLANK))]
    both = [(x >> 64, x & _MASK) for _, s in lines for x in (xxhash.xxh3_128_intdigest(s),)]
    h, flat = [a - (1 << 63) for a, _ in both], [x - (1 << 63) for pair in both for x in pair]
    long = [len(s.split()) >= long_words for _, s in lines]
    picked = {i for i, v in enumerate(long) if v}
    for a in range(len(h) - run_lines + 1):
        picked.add(min(range(a, a + run_lines), key=lambda j: (h[j], -j)))
    for i in sorted(picked):
        a, b = max(0, i - run_lines + 1), min(len(h), i + run_lines)
        yield h[i], i, long[i], i - a, flat[2 * a : 2 * b], [lines[j][0] for j in range(a, b)]


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, th, removed): numbers, from 0, of the lines to delete; only rows that lose lines. th is the text's hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, ths = batch.column("id"), batch.column("th")
            take, out = [], []
            for k, t in enumerate(utf8(batch.column("text"))):
                for f in fingerprints(t, run_lines, long_words):
                    take.append(k)
                    out.append(f)
            if out:
                fp, pos, long, at, near, numbers = zip(*out)
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp, pa.int64()), ids.take(take), ths.take(take), pa.array(pos, pa.int32()), pa.array(long), pa.array(at, pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32()))],
                    ["fp", "id", "th", "pos", "long", "at", "near", "numbers"],
                )

    fps = cut(rows.transform(in_arrow, run, f"fp bigint, id {kind}, th bigint, pos int, long boolean, at int, near array<bigint>, numbers array<int>"), "line-fingerprints", large=True)
    # Nulls come last in the order of ids.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos").alias("place")
    shared = fps.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("fp")
    # Cut, as first below, so that the joins deal both their sides and Spark can split a line that many texts have.
    shared = cut(shared, "line-shared")
    live = fps.join(shared, "fp", "left_semi")
    # Both ways from the fingerprint: each window of run_lines lines that holds it, and the line alone if it is long.
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - (run_lines - 1)), F.least(F.col("at"), F.size("numbers") - run_lines))
    windows = F.when(F.size("numbers") - run_lines >= F.greatest(F.lit(0), F.col("at") - (run_lines - 1)), F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(run_lines).alias("n"))))
    alone = F.when(F.col("long"), F.array(F.struct(F.col("at").alias("start"), F.lit(1).alias("n"))))
    none = F.array().cast("array<struct<start:int,n:int>>")
    runs = live.withColumn("w", F.explode(F.concat(F.coalesce(windows, none), F.coalesce(alone, none))))
    runs = runs.select(
        F.slice("near", 2 * F.col("w.start") + 1, 2 * F.col("w.n")).alias("key"), "id", "th", (F.col("pos") - F.col("at") + F.col("w.start")).alias("pos"),
        F.slice("numbers", F.col("w.start") + 1, F.col("w.n")).alias("numbers"),
    ).distinct()
    runs = cut(runs, "line-runs", large=True)
    forget(fps, shared)
    first = runs.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = cut(first, "line-first")
    later = runs.join(first, "key").filter(~F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos").eqNullSafe(F.col("first")))
    return later.select("id", "th", F.explode("numbers").alias("number")).distinct().groupBy("id", "th").agg(F.collect_list("number").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per input row: id, text (without the deleted lines), n_lines, removed (sorted line numbers from 0).

    A line is deleted if it is part of run_lines consecutive lines, or is a line of long_words words or more, that came before: in a row with a smaller
    id (null ids last), or higher up in its own text. Lines are compared without blanks at their ends; blank lines are passed over and kept. Wholly equal rows count as one and lose the same
    lines. A null text stays null with 0 lines, an empty one has one line. An empty table gives no rows. Other columns are ignored.
    """
    gone = removed_lines(docs, id_col, text_col, run_lines, long_words).withColumnsRenamed({"id": "id2", "th": "th2"})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left").select("id", "text", "removed")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, n, sets = [], [], []
            for t, r in zip(utf8(batch.column("text")), batch.column("removed").to_pylist()):
                lines = [] if t is None else t.split(b"\n")
                drop = set(r or ())
                texts.append(t if not drop else b"\n".join(x for i, x in enumerate(lines) if i not in drop))
                n.append(len(lines))
                sets.append(sorted(drop))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], ["id", "text", "n_lines", "removed"])

    return both.transform(in_arrow, run, f"id {kind}, text string, n_lines bigint, removed array<int>").withColumnsRenamed({"id": id_col, "text": text_col})


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.md5("text").alias("text_md5"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM l),
w AS (SELECT *, lead(s, 1) OVER d AS s1, lead(s, 2) OVER d AS s2, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2,
  len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 8 AS long FROM b WHERE s <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again1, row_number() OVER (PARTITION BY s, s1, s2 ORDER BY doc_id, i) > 1 AND s2 IS NOT NULL AS again3 FROM w),
gone AS (SELECT doc_id, i FROM r WHERE long AND again1 UNION SELECT doc_id, i FROM r WHERE again3 UNION SELECT doc_id, i1 FROM r WHERE again3 UNION SELECT doc_id, i2 FROM r WHERE again3),
o AS (SELECT l.doc_id, l.line, l.i, gone.i IS NOT NULL AS dropped FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS text_md5 FROM o GROUP BY doc_id
"""
