"""Exact top-k search by inner product over norm-sorted vectors.

Components are scaled and floored to integers, so scores are exact. The searched vectors are put in order of descending length and cut into blocks; queries meet the blocks in rounds, longest first, and
each round raises the score that a query's k-th result has. A query is done when its length times the greatest length left can't reach that score (Cauchy-Schwarz), so later rounds move only queries and
blocks that still can meet. Inside a pair of blocks both sides are rotated by the singular vectors of all searched vectors, so the first coordinates hold most of a product: a partial sum over them plus the
product of the lengths of what is left bounds the score, and only pairs whose bound reaches the k-th score are multiplied out, in integers.

Both sides of a round are dealt into cells of bounded size, a matrix product each; k rows for a query leave a cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, forget

#: Rows of a cell's sides; rows of a block that are compared at once; blocks of the first round, and how many times more each next one has.
QUERY_BLOCK, BLOCK, SLICE, FIRST, GROWTH = 1024, 4096, 1024, 1, 4
#: Quantiles of what queries need, at most.
QUANTILES = 256
#: Shares of the rotated coordinates after which bounds are taken.
STAGES = (0.125, 0.25, 0.5)
#: Products of lengths from here on aren't exact in doubles, and are made of Python's integers.
EXACT, LONG = float(1 << 53), (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int, str]:
    """((rid, id, v, sq), dimensions, number format): v holds floor(scale * x) of each component as bytes, sq is its squared length. Vectors that are null or hold null or non-finite components are left out; shorter
    ones are filled up with zeros. rid tells equal rows apart."""
    e = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    e = e.filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & (F.abs(c * scale) < float("inf"))))  # NaN is greater than infinity here
    dim, top = e.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()
    dim, top = max(dim or 0, 1), abs(top or 0.0) * abs(scale) + 1
    number = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"

    def floors(batches):
        for batch in batches:
            lists = batch.column("x")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            m = np.zeros((batch.num_rows, dim))
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            m[of, np.arange(ends[0], ends[-1]) - ends[:-1][of]] = flat[ends[0] : ends[-1]]
            m = np.floor(m * scale)
            data = m.astype(number)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array([r.tobytes() for r in data], pa.binary()), pa.array((m * m).sum(1))], ["rid", "id", "v", "sq"])

    return e.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "x").mapInArrow(floors, "rid long, id long, v binary, sq double"), dim, number


def _matrix(v, number: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), number).reshape(-1, dim).astype(float)


def rotation(vectors: DataFrame, dim: int, number: str) -> np.ndarray:
    """The right singular vectors of all vectors, strongest first, from the sum of v v' (summed in tasks, then by row). It is a matrix of dim x dim numbers, however many vectors there are."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), number, dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "x"])

    parts = vectors.select("v").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    gram = np.zeros(dim * dim)
    for r in parts.collect():
        gram[r["at"]] = r["x"]
    gram = gram.reshape(dim, dim)
    return np.linalg.svd(gram)[0] if np.isfinite(gram).all() else np.eye(dim)


def _by_integers(q: np.ndarray, p: np.ndarray, own: np.ndarray, k: int, p_ids: np.ndarray) -> list[tuple]:
    """(query's row, pool row, score) of the k best of each query, for products beyond what doubles hold; scores beyond a long count as its limit."""
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    out, wq, wp = [], whole(q), whole(p)
    for r in range(len(q)):
        scores = [(-max(-LONG - 1, min(LONG, int(s))), i, c) for c, (s, i) in enumerate(zip(wp @ wq[r], p_ids)) if not own[r, c]]
        out += [(r, c, -s) for s, _, c in sorted(scores)[:k]]
    return out


def best_products(q: np.ndarray, q_rid: np.ndarray, floor: np.ndarray, p: np.ndarray, p_rid: np.ndarray, p_ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of p, scores): for each query the k best pool rows whose score reaches its floor (ties by id, then as the rows stand), its own row left out."""
    order = np.argsort(-(p * p).sum(1), kind="stable")
    p, p_rid, p_ids = p[order], p_rid[order], p_ids[order]
    q_len, p_len = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))
    if q_len.max(initial=0) * p_len.max(initial=0) >= EXACT:
        found = _by_integers(q, p, q_rid[:, None] == p_rid[None, :], k, p_ids)
        r, c, s = (np.array([x[i] for x in found], np.int64) for i in range(3))
        return r, order[c], s
    qr, pr = q @ turn, p @ turn
    ends = sorted({max(1, int(len(turn) * share)) for share in STAGES})
    rest = lambda m: [np.sqrt((m[:, e:] * m[:, e:]).sum(1)) for e in ends]
    q_rest, p_rest = rest(qr), rest(pr)
    best, got = np.full((len(q), k), -np.inf), []
    least = floor.copy()
    for a in range(0, len(p), SLICE):
        b = min(a + SLICE, len(p))
        # A bound is at most 1/2 below a score that it bounds, and scores are integers.
        slack = 0.5 + 1e-12 * q_len * p_len[a]
        live = np.flatnonzero(q_len * p_len[a] + slack >= least)
        if not len(live):
            break
        start = qr[live, : ends[0]] @ pr[a:b, : ends[0]].T
        r, c = np.nonzero((start + q_rest[0][live, None] * p_rest[0][None, a:b] >= (least - slack)[live, None]) & (q_rid[live, None] != p_rid[None, a:b]))
        if len(r) * 4 > start.size:  # most may count: all are multiplied out
            score = q[live] @ p[a:b].T
        else:
            part = start[r, c]
            for n in range(1, len(ends)):
                part = part + np.einsum("ij,ij->i", qr[live[r], ends[n - 1] : ends[n]], pr[a + c, ends[n - 1] : ends[n]])
                stay = part + q_rest[n][live[r]] * p_rest[n][a + c] >= (least - slack)[live[r]]
                r, c, part = r[stay], c[stay], part[stay]
            score = np.full(start.shape, -np.inf)
            score[r, c] = np.einsum("ij,ij->i", q[live[r]], p[a + c])
        score[q_rid[live, None] == p_rid[None, a:b]] = -np.inf
        r, c = np.nonzero(score >= least[live, None])
        got.append((live[r], a + c, score[r, c]))
        hit = np.unique(r)
        both = np.concatenate([best[live[hit]], score[hit]], axis=1)
        best[live[hit]] = -np.partition(-both, k - 1, axis=1)[:, :k]
        least = np.maximum(least, best.min(1))
    if not got:
        return (np.empty(0, np.int64),) * 3
    r, c, s = (np.concatenate(x) for x in zip(*got))
    keep = (s >= least[r]) & (s > -np.inf)
    r, c, s = r[keep], c[keep], s[keep]
    at = np.lexsort((c, p_ids[c], -s, r))
    r, c, s = r[at], c[at], s[at]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], order[c[place < k]], s[place < k].astype(np.int64)


#: Null ids come after all others.
_LAST = np.iinfo(np.int64).max


def _grouped(queries: DataFrame, n: int) -> DataFrame:
    """queries with `need`, the length that a vector must have to count, and `group`: about QUERY_BLOCK queries each. Those that need about the same length stand together, so that a group meets few blocks: needs are dealt
    to quantiles, and a quantile's queries (many may need the same) to as many groups as their number asks for."""
    need = F.when(F.col("least") <= 0, -1.0).when(F.col("sq") == 0, float("inf")).otherwise(F.col("least") / F.sqrt("sq"))
    rows = queries.withColumn("need", need)
    cuts = min(QUANTILES, -(-n // QUERY_BLOCK))
    bounds = rows.agg(F.percentile_approx("need", [i / cuts for i in range(1, cuts)])).first()[0] if cuts > 1 else []
    rows = rows.withColumn("q", F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda x: x <= F.col("need"))) if bounds else F.lit(0))
    splits = {r["q"]: -(-r["n"] // QUERY_BLOCK) for r in rows.groupBy("q").agg(F.count("*").alias("n")).collect()}
    first, table = 0, []
    for q, m in sorted(splits.items()):
        table.append((q, first, m))
        first += m
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, "q int, first int, m int")), "q").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("m"))).cast("int")).drop("q", "first", "m")


def top_products(rows: DataFrame, k: int, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets is_query (SQL over `id`) the k rows of greatest integer inner product, its own row left out; fewer if there are no more. Ranks from 1, ties to the smaller id.

    A component x counts as floor(scale * x) in double. Vectors that are null or hold null or non-finite components take no part; where lengths differ, missing components count as 0, so an empty vector scores
    0. Rows with an id that others have too are rows of their own: each may be a result of the others. A null id comes last in ties. Scores beyond a long count as its limit. An empty table gives no rows; other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    made, dim, number = integer_vectors(rows, id_col, vector_col, scale)
    vectors = cut(made, "products-vectors")
    turn = rotation(vectors, dim, number)
    # Equal lengths are split by rid, so however many there are, blocks stay even.
    blocks = cut(vectors.repartitionByRange(max(1, -(-vectors.count() // BLOCK)), F.desc("sq"), "rid").withColumn("block", F.spark_partition_id()), "products-blocks")
    # The greatest length in each block that has rows, in descending order: a number for BLOCK rows. What compares with one is rounded towards comparing too much.
    longest = [(r["block"], float(np.sqrt(r["sq"])) * (1 + 1e-9)) for r in blocks.groupBy("block").agg(F.max("sq").alias("sq")).orderBy("block").collect()]
    queries = cut(vectors.filter(is_query).withColumn("least", F.lit(float("-inf"))), "products-queries")
    forget(vectors)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"rid": [], "query_id": [], "vec_id": [], "score": []}).astype({"rid": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"})
        rid, ids = a["rid"].to_numpy(), b["id"].astype("Int64")
        r, c, s = best_products(_matrix(a["v"], number, dim), rid, a["least"].to_numpy(), _matrix(b["v"], number, dim), b["rid"].to_numpy(), ids.fillna(_LAST).to_numpy(np.int64), turn, k)
        return pd.DataFrame({"rid": rid[r], "query_id": a["id"].to_numpy()[r], "vec_id": ids.iloc[c].array, "score": s})

    found, at, size = None, 0, FIRST
    while at < len(longest) and (n := queries.count()):
        groups = cut(_grouped(queries, n), "products-groups")
        reach = queries.sparkSession.createDataFrame(longest[at : at + size], "block int, longest double")
        cells = groups.groupBy("group").agg(F.min("need").alias("need")).withColumn("block", F.explode(F.sequence(F.lit(longest[at][0]), F.lit(longest[at : at + size][-1][0]))))
        cells = cut(cells.join(reach, "block").filter("longest >= need").select("group", "block"), "products-cells")
        sides = (x.join(cells, by).groupBy("group", "block") for x, by in ((groups, "group"), (blocks, "block")))
        new = next(sides).cogroup(next(sides)).applyInPandas(meet, "rid long, query_id long, vec_id long, score long")
        both = new if found is None else new.unionByName(found.drop("rank"))
        order = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        best = cut(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "products-found")
        at, size = at + size, size * GROWTH
        if at < len(longest):
            least = best.filter(F.col("rank") == k).select("rid", F.col("score").cast("double").alias("kth"))
            ahead = groups.select("rid", "id", "v", "sq").join(least, "rid", "left").select("rid", "id", "v", "sq", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
            ahead = cut(ahead.filter(F.sqrt("sq") * longest[at][1] >= F.col("least")), "products-queries")
        forget(queries, groups, cells, *([found] if found is not None else []))
        queries, found = ahead if at < len(longest) else queries, best
    forget(blocks)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")


def op12_top_products(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, "id % 20 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score FROM v q JOIN v p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
