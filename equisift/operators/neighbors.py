"""Exact k nearest neighbours by cosine, and the support sets made of them.

The pool is dealt to pivots (some of its own rows): each row goes to the nearest, and a pivot knows how far its rows are away at least and at most. A first meeting with the rows of its own pivot gives each query
a k-th similarity to beat; then the triangle inequality on unit vectors tells, from the distances to pivots alone, which pivots can hold a better row, and only to those does the query move. All bounds are on the safe
side, so the result is exact. What meets is dealt into blocks of bounded size, a matrix product each, and only the k best of a block leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import settle

QUERY_BLOCK, POOL_BLOCK, DIGITS = 2048, 8192, 9
#: Pivots at most; beyond as many blocks a pivot has more rows, which are dealt into parts. What goes to every task is a vector for each pivot.
MOST_PIVOTS = 4096
#: Distances are compared with this to spare, for similarities are rounded.
SLACK = 1e-4
#: More than rounding moves a similarity.
SPARE = 1e-8
#: Similarities or distances that a worker holds at once (8 bytes each), and those that a task works out in all; what makes more is dealt to more tasks. So are rows that move.
CELLS, TASK_CELLS = 1 << 19, 1 << 30
TASK_ROWS = 1 << 17


def _units(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _in_arrow(rows: DataFrame, add, fields: str, points: int) -> DataFrame:
    """rows with columns made of the unit vectors of a few rows, `points` of which meet as many pivots; add gives their arrays. A batch is taken in parts of at most CELLS distances."""
    most = max(1, CELLS // max(points, 1))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                yield pa.RecordBatch.from_arrays([*batch.columns, *add(batch, _units(batch.column("v")))], [*batch.schema.names, *(f.split()[0] for f in fields.split(", "))])

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", " + fields)


def _by_pivot(rows: DataFrame, counts: list[tuple[int, int, int]]) -> DataFrame:
    """(pivot, parts, blocks) for a broadcast join. Given as Arrow it stays a local table; of a list Spark makes an RDD, for which each executor would start a second set of Python workers."""
    names = ("pivot", "parts", "blocks")
    return F.broadcast(rows.sparkSession.createDataFrame(pa.table({n: pa.array([c[i] for c in counts], pa.int32()) for i, n in enumerate(names)})))


def _dealt(rows: DataFrame, cells: int, *by: str, moved: int = 0) -> DataFrame:
    """rows by a hash of `by` in as many tasks as so many distances, or moved rows, need. The few bytes of a vector say nothing of its work, so neither the files nor the sizes of a shuffle can decide that."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // TASK_CELLS), -(-moved // TASK_ROWS)), *by)


def _meetings(left: DataFrame, right: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(q_id, p_id, sim): of each block the k best rows for each query that reach its `least`."""
    names, kinds = ["q_id", "p_id", "sim"], [pa.int64(), pa.int64(), pa.float64()]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.sort_by("id").combine_chunks()
            own, ids, least = (x.to_numpy() for x in (a.column("id"), b.column("id"), a.column("least")))
            qs, units = (_units(x.column("v").combine_chunks()) for x in (a, b))
            for part in np.array_split(np.arange(len(own)), -(-len(own) * len(ids) // CELLS)):
                sim = qs[part] @ units.T
                if exclude_self:
                    sim[own[part][:, None] == ids[None, :]] = -np.inf
                # Only what may reach the floor is rounded. Most queries have few such rows here; of more than k, all that reach the k-th best, so that ties can be settled by id.
                floor = np.maximum(least[part] - SPARE, np.finfo(float).min)
                full = np.flatnonzero(np.count_nonzero(sim >= floor[:, None], axis=1) > k)
                for some in np.array_split(full, -(-len(full) // 16)) if len(full) else ():
                    floor[some] = np.maximum(floor[some], -np.partition(-sim[some], k - 1, axis=1)[:, k - 1] - SPARE)
                r, c = np.divmod(np.flatnonzero(sim >= floor[:, None]), len(ids))
                near = np.round(sim[r, c], DIGITS) + 0.0
                at = np.lexsort((ids[c], -near, r))
                at = at[near[at] >= least[part][r[at]]]
                r, c, near = r[at], c[at], near[at]
                few = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((own[part][r[few]], ids[c[few]], near[few]))
        return pa.table([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*out), kinds)], names)

    by = ("pivot", "part", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "q_id long, p_id long, sim double")


def nearest(
    queries: DataFrame, pool: DataFrame, k: int, exclude_self: bool = False, row_id: str = "row_id", vector: str = "v", pool_block: int | None = None, query_block: int | None = None, report: dict | None = None,
) -> DataFrame:
    """(q_id, rank, p_id, sim): the k pool rows of greatest cosine for each query, ranks from 1; equal ones (to 9 digits) by id.

    A zero vector has cosine 0 with all. exclude_self leaves out the pool row with the query's own id. k = 0 gives none. Null vectors take no part. A report gets `pairs`, how many pairs of a query and a row were
    compared, and `of`, how many there are.
    """
    q, p = (x.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null") for x in (queries, pool))
    if k < 1:
        return q.sparkSession.createDataFrame([], "q_id long, rank int, p_id long, sim double")
    number = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    pool_block, query_block = pool_block or POOL_BLOCK, query_block or QUERY_BLOCK
    counts = [x.agg(F.lit(side).alias("side"), F.count("*").alias("n")) for side, x in (("pool", p), ("queries", q))]
    both = dict(map(tuple, counts[0].unionByName(counts[1]).collect()))
    n, nq = both["pool"], both["queries"]
    m = min(MOST_PIVOTS, -(-n // pool_block))
    if m < 2:  # one block: there is nothing to prune
        placed, reached = p.withColumn("pivot", F.lit(0)), q.withColumns({"least": F.lit(float("-inf")), "pivots": F.array(F.lit(0))})
        sizes, wanted = {0: (n, 0.0, 0.0)}, {0: nq}
    else:
        placed, reached, sizes, wanted = _pruned(q, p, nq, n, k, m, exclude_self, pool_block, query_block, number)
    pairs = sum(sizes[x][0] * c for x, c in wanted.items())
    if report is not None:
        report.update(pairs=pairs, of=n * nq)
    moved = sum(-(-sizes[x][0] // pool_block) * c + sizes[x][0] * -(-c // query_block) for x, c in wanted.items())
    return _ranked(*_sides(placed, reached, sizes, wanted, pool_block, query_block, number), k, exclude_self, pairs, moved)


def _sides(placed: DataFrame, reached: DataFrame, sizes: dict, wanted: dict, pool_block: int, query_block: int, number) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into cells: a pivot's rows in parts, and the queries that reach it in blocks. A row moves to as many blocks as its pivot's queries fill."""
    few = [(x, -(-sizes[x][0] // pool_block), -(-c // query_block)) for x, c in wanted.items() if c and sizes[x][0]]
    # A row for each pivot, MOST_PIVOTS + 1 at most.
    table = _by_pivot(placed, few)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = reached.select("id", "v", "least", F.explode("pivots").alias("pivot")).join(table, "pivot").select("id", "v", "least", "pivot", every("parts").alias("part"), number(F.col("blocks")).alias("block"))
    right = placed.select("id", "v", "pivot").join(table, "pivot").select("id", "v", "pivot", number(F.col("parts")).alias("part"), every("blocks").alias("block"))
    return left, right


def _ranked(left: DataFrame, right: DataFrame, k: int, exclude_self: bool, cells: int, moved: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy(F.col("sim").desc(), "p_id")
    by = ("pivot", "part", "block")
    return _meetings(_dealt(left, cells, *by, moved=moved), _dealt(right, cells, *by, moved=moved), k, exclude_self).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q_id", "rank", "p_id", "sim")


def _pruned(q: DataFrame, p: DataFrame, nq: int, n: int, k: int, m: int, exclude_self: bool, pool_block: int, query_block: int, number) -> tuple[DataFrame, DataFrame, dict, dict]:
    """(pool with pivot, queries with least and pivots, by pivot: rows, least and greatest distance; by pivot: queries)."""
    drawn = [r["v"] for r in p.orderBy(F.xxhash64("id"), "id").limit(m).collect()]
    points = _units(pa.array(drawn, pa.list_(pa.float64())))
    points = points[np.any(points != 0, axis=1)]

    def place(batch, units):
        if not len(points):
            return [pa.array(np.full(len(units), -1, np.int32)), pa.array(np.zeros(len(units)))]
        sim = units @ points.T
        near = sim.argmax(1)
        away = np.sqrt(np.maximum(2 - 2 * sim[np.arange(len(units)), near], 0))
        zero = ~np.any(units != 0, axis=1)  # on no sphere: kept by themselves, and never left out
        return [pa.array(np.where(zero, -1, near).astype(np.int32)), pa.array(away)]

    placed = settle(_in_arrow(_dealt(p, n * len(points), "id"), place, "pivot int, away double", len(points)))
    sizes = {r["pivot"]: (r["n"], r["low"], r["high"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}
    held = np.array(sorted(x for x in sizes if x >= 0), np.int32)
    low, high = (np.array([sizes[x][i] for x in held.tolist()]) for i in (1, 2))

    def home(batch, units):
        if not len(held):
            return [pa.array(np.full(len(units), -1, np.int32))]
        return [pa.array(held[(units @ points[held].T).argmax(1)])]

    # One part of its own pivot is enough for a first k-th similarity.
    first = _in_arrow(_dealt(q, nq * len(held), "id"), home, "pivot int", len(held)).select("id", "v", F.lit(float("-inf")).alias("least"), "pivot", F.lit(0).alias("part"))
    homes = {r["pivot"]: r["n"] for r in first.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    table = _by_pivot(p, [(x, -(-sizes[x][0] // pool_block), -(-c // query_block)) for x, c in homes.items()])
    left = first.join(table, "pivot").select("id", "v", "least", "pivot", "part", number(F.col("blocks")).alias("block"))
    right = placed.join(table, "pivot").withColumn("part", number(F.col("parts"))).filter("part = 0").select("id", "v", "pivot", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # A part is some pool_block rows.
    cells, moved = pool_block * nq, nq + sum(min(pool_block, sizes[x][0]) * -(-c // query_block) for x, c in homes.items())
    least = _ranked(left, right, k, exclude_self, cells, moved).filter(F.col("rank") == k).select(F.col("q_id").alias("id"), F.col("sim").alias("least"))

    def reach(batch, units):
        apart = _apart(units, points[held])
        most = np.sqrt(np.maximum(2 - 2 * batch.column("least").to_numpy(), 0))[:, None] + SLACK
        can = (apart - high <= most) & (low - apart <= most) | ~np.any(units != 0, axis=1)[:, None]
        return [pa.array([np.append(held[row], extra) for row in can], pa.list_(pa.int32()))]

    extra = np.array([-1] if -1 in sizes else [], np.int32)
    # Queries may repeat an id; one k-th similarity for each id is the least of theirs.
    known = q.join(least.groupBy("id").agg(F.min("least").alias("least")), "id", "left").select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    reached = settle(_in_arrow(_dealt(known, nq * len(held), "id"), reach, "pivots array<int>", len(held)))
    wanted = {r["pivot"]: r["n"] for r in reached.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    return placed, reached, sizes, wanted


def support(neighbors: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, q_id, rank, p_id, sim): neighbours with the batch of their query. batches: (q_id, batch_id)."""
    return neighbors.join(batches, "q_id").select("batch_id", "q_id", "rank", "p_id", "sim")


def support_union(sets: DataFrame) -> DataFrame:
    """Distinct (batch_id, p_id)."""
    return sets.select("batch_id", "p_id").distinct()


def validation(sets: DataFrame) -> DataFrame:
    """(batch_id, q_id, p_id): the closest neighbour of each query; one that several queries share is there for each."""
    return sets.filter("rank = 1").select("batch_id", "q_id", "p_id")


def candidates(sets: DataFrame) -> DataFrame:
    """(batch_id, p_id) of the support that is nobody's closest neighbour in its batch."""
    return support_union(sets).join(validation(sets).select("batch_id", "p_id"), ["batch_id", "p_id"], "left_anti")
