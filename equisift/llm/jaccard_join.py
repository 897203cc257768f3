"""N-gram Jaccard join by a token-group matrix.

Documents with one shingle set are a class. Similar classes are put into groups, and the matrix has, for each shingle (token) that can
decide about a link, the groups whose union of sets holds it. A query class is counted against the matrix; the count
bounds its overlap with every member of a group, and only groups that reach the bound are opened: their members are compared with the query, exactly.

Only tokens of a prefix are in the matrix. In any fixed order of all tokens, two sets with Jaccard similarity of t or more share one of their first
n - ceil(t n) + 1 tokens, so nothing is lost. The order puts common tokens last (by a count sketch of all documents), so a
passage that many documents share is in few prefixes.

Steps, each cut in the shared folder:
  1. classes and the sketch; 2. prefixes of all classes, of which tokens with one class end there; 3. groups: each class is
  compared with the class it shares most hub tokens with (a token's hub is its most central class), and links make groups, so a family of thousands
  of near copies costs a comparison each; 4. matrix, bound, opened groups, exact comparison; 5. components of all links.
Pairs inside a group are known to be connected and are never formed. Classes are compared by their whole shingle sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, connected, cut, forget, in_arrow, shingles, utf8

#: The sketch: counts of 2**SKETCH_BITS buckets of tokens (64 MB for each running task), in SKETCH_PARTS parts.
SKETCH_BITS, SKETCH_PARTS = 24, 64
#: A bucket with COMMON_LEAST tokens and so many times the mean count holds common tokens; each doubling is one level more.
COMMON_FROM, COMMON_LEAST = 4, 32
#: Spokes of a hub that are compared in one task.
BLOCK = 256
#: Ids (two longs each) that are broadcast at most: 16 MB.
BROADCAST_ROWS = 1 << 20
#: Groups of more classes are opened in blocks of BLOCK_LEAST to BLOCK_TOKENS rows of the matrix, and of as many rows of queries: about BLOCK_PAIRS pairs of blocks, more for groups whose blocks would be larger.
LARGE, BLOCK_LEAST, BLOCK_TOKENS, BLOCK_PAIRS = 64, 1 << 10, 1 << 16, 256
_SEEN = 500_000


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a shingle set, as two signed longs."""
    raw = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def prefix(tokens: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first n - ceil(t n) + 1 tokens in the order (level, hash), tokens being sorted; and how central the set is: the sum of its tokens' levels for each 1000 tokens,
    greatest for the text that a family of near copies goes back to, as a change makes rare tokens of common ones."""
    n = len(tokens)
    own = levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return tokens[np.argsort(own, kind="stable")[: n - (percent * n + 99) // 100 + 1]], int(own.sum(dtype=np.int64)) * 1000 // n


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, lo, hi) of each row, and the sketch's parts of each task (n is -1)."""

    def run(batches):
        words, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            n, lo, hi, own = [], [], [], []
            for t in utf8(batch.column("text")):
                s = shingles(t, words, k)
                a, b = class_of(s) if len(s) else (0, 0)
                n.append(len(s))
                lo.append(a)
                hi.append(b)
                own.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            if own:
                np.add.at(counts, np.concatenate(own), np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["id", "n", "lo", "hi", "part", "counts"]
            )
        if kind is not None and counts.any():
            parts = [zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1) for x in np.split(counts, SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_PARTS, kind), pa.array([-1] * SKETCH_PARTS, pa.int64()), pa.array([0] * SKETCH_PARTS, pa.int64()), pa.array([0] * SKETCH_PARTS, pa.int64()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())],
                ["id", "n", "lo", "hi", "part", "counts"],
            )

    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, lo bigint, hi bigint, part int, counts binary")


def _levels(found: DataFrame) -> np.ndarray:
    """The level of each bucket: 0 for tokens that aren't common. What comes to the driver is one byte for each bucket (16 MB, compressed), at any input size."""
    total = found.filter("n > 0").agg(F.sum("n")).first()[0] or 0
    base = max(COMMON_FROM * total / (1 << SKETCH_BITS), COMMON_LEAST)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), np.uint16).astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            levels = np.where(x >= base, np.floor(np.log2(np.maximum(x, 1) / base)) + 1, 0).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "levels": pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())})

    rows = found.filter("n = -1").select("part", "counts").repartition(SKETCH_PARTS, "part").transform(in_arrow, run, "part int, levels binary").collect()
    levels = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for r in rows:
        levels[r["part"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return levels.ravel()


def _prefixes(rows: DataFrame, levels, clashes: frozenset, k: int, percent: int) -> DataFrame:
    """(token, cls, n, central): the prefix of each class, once for each task that meets it."""

    def run(batches):
        words, seen = WordHashes(), set()
        for batch in batches:
            tokens, cls, n, central = [], [], [], []
            for t in utf8(batch.column("text")):
                s = shingles(t, words, k)
                if not len(s):
                    continue
                lo, hi = class_of(s)
                own = hi if lo in clashes else lo
                if own in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(own)
                first, middle = prefix(s, levels.value, percent)
                tokens.append(first.view(np.int64))
                central.append(middle)
                cls.append(own)
                n.append(len(s))
            if tokens:
                sizes = [len(x) for x in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(cls, np.int64), sizes)), pa.array(np.repeat(np.array(n, np.int32), sizes)), pa.array(np.repeat(np.array(central, np.int32), sizes))], ["token", "cls", "n", "central"])

    return rows.select("text").transform(in_arrow, run, "token bigint, cls bigint, n int, central int")


def _needed(a: str, b: str, percent: int) -> str:
    """SQL: the least number of shared prefix tokens of two linked sets of sizes a and b. Their overlap is ceil(t / (1 + t) (a + b)) at least; beyond the prefix that ends first there are ceil(t n) - 1 tokens."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent} - greatest(({percent} * {a} + 99) div 100, ({percent} * {b} + 99) div 100) + 1)"


def _least_needed(n: str, low: str, high: str, percent: int) -> str:
    """SQL: the least of _needed(n, m) over the sizes m from low to high that can link with a set of size n; some such size must exist.

    Up to n it rises with m, so its least is at the low end. Above n it is ceil(x) - ceil(y) + 1 with x - y falling by t^2 / (1 + t) for each m: from the high end it dips
    by rounding, but sizes ceil((1 + t) / t^2) or more below that end need no fewer than the end does, so the sizes nearer to it are all tried.
    """
    low, high = (f"least(greatest({e}, ({percent} * {n} + 99) div 100), (100 * {n}) div {percent})" for e in (low, high))
    tried = -(-100 * (100 + percent) // percent**2)
    return f"least({', '.join(_needed(n, m, percent) for m in (low, *(f'greatest({low}, {high} - {i})' for i in range(tried))))})"


def _verify(pairs: DataFrame, rows: DataFrame, first: DataFrame, clashes: frozenset, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole shingle sets reach the similarity. rows: (id, text); first: (cls, first_id), an id of each class.

    The ids of the classes in question are broadcast if they are BROADCAST_ROWS at most, which is counted; else both sides are shuffled.
    Spokes a meet their hub b in blocks of about BLOCK, so a hub with many spokes is dealt over many tasks; a task holds one hub's set and a batch of rows.
    """
    asked = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(first, "cls"), "jaccard-asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = cut(rows.join(side, F.col("id").eqNullSafe(F.col("first_id"))).select("cls", "text"), "jaccard-texts", large=True)
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(degree, "b").select("a", "b", F.expr("pmod(xxhash64(a), blocks)").alias("block"), "blocks")
    spokes = dealt.select(F.col("a").alias("cls"), "b", "block", F.lit(1).alias("kind"))
    hubs = degree.select(F.col("b").alias("cls"), "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    met = spokes.unionByName(hubs).join(texts, "cls").repartition("b", "block").sortWithinPartitions("b", "block", "kind")

    def run(batches):
        words, at, hub = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for cls, to, block, kind, t in zip(*(batch.column(c).to_pylist() for c in ("cls", "b", "block", "kind")), utf8(batch.column("text"))):
                s = shingles(t, words, k)
                lo, hi = class_of(s) if len(s) else (0, 0)
                if (hi if lo in clashes else lo) != cls:  # another row with this id
                    continue
                if kind == 0:
                    at, hub = (to, block), s
                elif at == (to, block):
                    common = len(np.intersect1d(s, hub, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(hub) - common):
                        a.append(cls)
                        b.append(to)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = cut(met.select("cls", "b", "block", "kind", "text").transform(in_arrow, run, "a bigint, b bigint"), "jaccard-links", large=True)
    forget(asked, texts)
    return out


def _open_large(inside: DataFrame, weighed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of query classes and classes of large groups that reach the bound. inside: (token, a, na, grp); weighed: (grp, token, cls, n, weight).

    A group's rows of the matrix are dealt into blocks by class, its queries too, and each pair of blocks is counted in numpy: the tokens that a query shares with each class are one bincount.
    """
    blocks = inside.groupBy("grp").agg(F.count("*").alias("asked")).join(weighed.select("grp", "weight").distinct(), "grp")
    size = F.least(F.lit(BLOCK_TOKENS), F.greatest(F.lit(BLOCK_LEAST), F.ceil(F.sqrt(F.col("asked") * F.col("weight") / F.lit(float(BLOCK_PAIRS))))))
    blocks = blocks.withColumn("size", size).select("grp", F.ceil(F.col("asked") / F.col("size")).alias("qs"), F.ceil(F.col("weight") / F.col("size")).alias("ms"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    q = inside.join(blocks, "grp").withColumn("qb", block("a", "qs")).withColumn("mb", every("ms")).select("grp", "qb", "mb", "token", "a", "na")
    m = weighed.join(blocks, "grp").withColumn("mb", block("cls", "ms")).withColumn("qb", every("qs")).select("grp", "qb", "mb", "token", F.col("cls").alias("b"), F.col("n").alias("nb"))

    def count(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found_a, found_b = [], []
        if len(q) and len(m):
            m = m.sort_values("token")
            tokens = m["token"].to_numpy()
            names, at = np.unique(m["b"].to_numpy(), return_inverse=True)
            nb = np.zeros(len(names), np.int64)
            nb[at] = m["nb"].to_numpy()
            for a, own in q.groupby("a"):
                na, mine = int(own["na"].iloc[0]), own["token"].to_numpy()
                low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
                size = high - low
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                c = np.bincount(at[rows], minlength=len(names))
                need = (percent * (na + nb) + 99 + percent) // (100 + percent) - np.maximum((percent * na + 99) // 100, (percent * nb + 99) // 100) + 1
                hit = names[(c > 0) & (c >= need) & (percent * na <= 100 * nb) & (percent * nb <= 100 * na)]
                found_a.append(np.full(len(hit), a, np.int64))
                found_b.append(hit)
        return pd.DataFrame({"a": np.concatenate(found_a or [np.empty(0, np.int64)]), "b": np.concatenate(found_b or [np.empty(0, np.int64)])})

    keys = ["grp", "qb", "mb"]
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(count, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that links reach, itself included).

    Two rows link when 100 * common >= percent * united over their sets of distinct k-word shingles (see common.shingles: a text with fewer words is one shingle). Null
    and empty texts, and texts of white space, have no shingles, link with nothing and are their own component. Equal texts link whatever their number.
    Rows with a null id take part; a component of such rows alone has a null component_id. Rows that share an id are rows of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(_classes(rows, k), "jaccard-classes")
    # 64 bits name a class; the few names that two sets share are told apart by the other 64.
    clash = found.filter("n > 0").groupBy("lo").agg(F.min("hi").alias("x"), F.max("hi").alias("y")).filter("x <> y").select("lo")
    clashes = frozenset(r["lo"] for r in clash.limit(100_001).collect())
    if len(clashes) > 100_000:
        raise RuntimeError("too many class names clash")
    cls = F.when(F.col("lo").isin(list(clashes)), F.col("hi")).otherwise(F.col("lo")) if clashes else F.col("lo")
    levels = spark.sparkContext.broadcast(_levels(found))
    members = found.filter("n >= 0").select("id", "n", F.when(F.col("n") > 0, cls).alias("cls"))

    # A token's least and greatest class are pre-aggregated, then, of tokens with several classes, the hub; both sides of each join are tables, so that Spark can split a token that many classes have.
    own = cut(_prefixes(rows, levels, clashes, k, percent), "jaccard-prefixes")
    levels.destroy()  # a lost executor reads the table, not the levels
    tokens = cut(own.groupBy("token").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("token"), "jaccard-tokens", large=True)
    shared = cut(own.join(tokens, "token", "left_semi").dropDuplicates(["token", "cls"]), "jaccard-shared", large=True)
    forget(own, tokens)
    hubs = cut(shared.groupBy("token").agg(F.max(F.struct("central", "cls")).alias("top")).select("token", F.col("top.cls").alias("hub")), "jaccard-hubs", large=True)

    first = members.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("first_id"))

    star = shared.join(hubs, "token").filter("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("20 * c >= n")
    star = cut(star.groupBy(F.col("cls").alias("a")).agg(F.max(F.struct("c", "hub")).alias("best")).select("a", F.col("best.hub").alias("b")), "jaccard-star", large=True)
    forget(hubs)
    links = _verify(star, rows, first, clashes, k, percent)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    groups = connected(nodes, links, "jaccard-groups")

    # The matrix: tokens that two groups at least have.
    matrix = shared.select("token", "cls", "n").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("label", "cls")).drop("label")
    every = cut(matrix, "jaccard-named", large=True)
    forget(shared)
    both = cut(every.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x <> y").select("token"), "jaccard-tokens")
    matrix = cut(every.join(both, "token", "left_semi"), "jaccard-matrix", large=True)
    forget(every, both)
    # Of two groups the smaller one's classes are queries to the larger one's union, so a family is met as one.
    sizes = matrix.groupBy("grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("weight"))
    weighed = cut(matrix.join(sizes, "grp"), "jaccard-weighed", large=True)
    forget(matrix)
    union = weighed.select("token", F.col("grp").alias("to"), "low", "high", "weight").distinct()
    near = f"{percent} * q.n <= 100 * u.high and {percent} * u.low <= 100 * q.n"
    counted = weighed.alias("q").join(union.alias("u"), F.expr(f"q.token = u.token and struct(q.weight, q.grp) < struct(u.weight, u.to) and {near}")).groupBy("q.cls", "q.n", "u.to", "u.low", "u.high").agg(F.count("*").alias("c"))
    open_ = counted.filter(F.expr(f"c >= {_least_needed('n', 'low', 'high', percent)}")).select("cls", "to")
    sized = groups.groupBy(F.col("label").alias("to")).agg(F.count("*").alias("members"))
    inside = weighed.join(open_.join(sized, "to", "left"), "cls").select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("to").alias("grp"), F.coalesce("members", F.lit(1)).alias("members"))
    inside = cut(inside, "jaccard-open", large=True)
    small = inside.filter(F.col("members") <= LARGE).join(weighed.select("token", "grp", F.col("cls").alias("b"), F.col("n").alias("nb")), ["token", "grp"])
    small = small.filter(f"{percent} * na <= 100 * nb and {percent} * nb <= 100 * na").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    small = small.filter(F.expr(f"c >= {_needed('na', 'nb', percent)}")).select("a", "b")
    pairs = small.unionByName(_open_large(inside.filter(F.col("members") > LARGE), weighed, percent))
    tried = star.select("a", "b").union(star.select("b", "a"))
    pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs", large=True)
    forget(weighed, inside)
    more = _verify(pairs, rows, first, clashes, k, percent)

    # Components of groups, then the least id of each.
    lookup = groups.withColumnRenamed("label", "grp")
    edges = more.join(lookup.withColumnsRenamed({"node": "a", "grp": "ga"}), "a", "left").join(lookup.withColumnsRenamed({"node": "b", "grp": "gb"}), "b", "left")
    edges = edges.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    joined = connected(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges, "jaccard-components")
    named = first.join(groups.select(F.col("node").alias("cls"), F.col("label").alias("grp")), "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    named = named.join(joined.select(F.col("node").alias("grp"), "label"), "grp", "left").select("cls", "first_id", F.coalesce("label", "grp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("cls").alias("c2"), "component_id")
    out = members.join(named, F.col("cls") == F.col("c2"), "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = cut(out, "jaccard-result")
    forget(found, star, links, groups, pairs, more, joined)
    return out


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
