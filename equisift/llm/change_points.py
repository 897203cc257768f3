"""Penalised change points of many series, by divide and conquer (CDQ) dynamic programming.

A series is cut into segments of a least length so that the sum of their costs plus a penalty for each cut is least. best[j], of the first j days, is the least over i of best[i] + cost(i, j): the left half of
the positions is solved first, then all it offers is pushed to the right half by blocked min-plus kernels (a tile of i against j, bounded in size), then the right half is solved. Keys are lexicographic: sum,
then number of segments; offers come in order of i and only a smaller key replaces one, so the earliest predecessor stays.

Spark sums rows by series and day first (partial sums, so a hot series is no burden), then gathers a series as one row: it has a value for each day of its span at most, however many rows there are. Series of equal
length are solved together in numpy. Time is the square of a series' days, memory is in proportion to them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Numbers in a tile of a kernel, over all series solved together; series of a stack.
TILE, STACK = 1 << 17, 256
#: A key that nothing reaches. Beyond SAFE, numbers are Python's integers. The greatest long.
NONE, SAFE, LONG = 1 << 62, 1 << 61, (1 << 63) - 1


def spread(n, s, q):
    """1 + floor of the variance: n values with sum s and sum of squares q, all integers."""
    return 1 + (n * q - s * s) // (n * n)


def cost(n, v):
    """n times the floor of 1000 ln v, with ln in double."""
    return n * np.floor(1000 * np.log(np.asarray(v).astype(float))).astype(np.int64)


class Stack:
    """Series of n days each (a matrix, a row for each), solved together."""

    def __init__(self, values: np.ndarray, least: int, penalty: int):
        self.n, self.least, self.penalty = values.shape[1], least, penalty
        total, square = np.abs(values.astype(float)).sum(1).max(), (values.astype(float) ** 2).sum(1).max()
        kind = np.int64 if max(total * total, self.n * square) < SAFE else object
        values = values.astype(kind)
        zero = np.zeros((len(values), 1), kind)
        self.sums, self.squares = (np.concatenate([zero, np.cumsum(x, axis=1, dtype=kind)], axis=1) for x in (values, values * values))
        # sum * base + segments: a series has fewer segments than base.
        self.base = self.n + 1
        self.best = np.full((len(values), self.n + 1), NONE, np.int64)
        self.best[:, 0] = 0
        self.before = np.zeros((len(values), self.n + 1), np.int64)
        self._solve(0, self.n + 1)

    def _solve(self, lo: int, hi: int) -> None:
        """Positions lo to hi - 1, to which all before lo has been pushed. So short a run has no segment inside."""
        if hi - lo <= self.least:
            return
        mid = (lo + hi) // 2
        self._solve(lo, mid)
        side = max(self.least, int((TILE // len(self.best)) ** 0.5))
        for a in range(lo, mid, side):
            b = min(a + side, mid)
            for c in range(max(mid, a + self.least), hi, side):
                self._push(a, b, c, min(c + side, hi))
        self._solve(mid, hi)

    def _push(self, a: int, b: int, c: int, d: int) -> None:
        """What positions a to b - 1 offer to c to d - 1."""
        n = np.arange(c, d) - np.arange(a, b)[:, None]
        s = self.sums[:, None, c:d] - self.sums[:, a:b, None]
        q = self.squares[:, None, c:d] - self.squares[:, a:b, None]
        long = np.maximum(n, 1)
        key = (cost(long, spread(long, s, q)) + self.penalty * (np.arange(a, b) > 0)[:, None]) * self.base + 1
        key += self.best[:, a:b, None]
        key[:, n < self.least] = NONE
        key[np.broadcast_to(self.best[:, a:b, None] == NONE, key.shape)] = NONE
        first = key.argmin(1)  # the earliest of equal ones
        least = np.take_along_axis(key, first[:, None], 1)[:, 0]
        better = least < self.best[:, c:d]
        self.best[:, c:d][better] = least[better]
        self.before[:, c:d][better] = (first + a)[better]

    def segments(self, row: int) -> tuple[list[tuple], int, int]:
        """((start, n, sum, spread, cost) of each segment in order, number of segments, best cost)."""
        if self.n < 2 * self.least:  # one segment
            ends = [0, self.n]
        else:
            ends = [self.n]
            while ends[-1]:
                ends.append(int(self.before[row, ends[-1]]))
            ends.reverse()
        out = []
        for a, b in zip(ends, ends[1:]):
            s, q = int(self.sums[row, b]) - int(self.sums[row, a]), int(self.squares[row, b]) - int(self.squares[row, a])
            v = spread(b - a, s, q)
            out.append((a, b - a, max(-LONG - 1, min(LONG, s)), min(LONG, v), int(cost(b - a, v))))
        return out, len(out), sum(x[4] for x in out) + self.penalty * (len(out) - 1)


_OUT = [("segment_no", pa.int32()), *((c, pa.int64()) for c in ("first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"))]


def change_points(rows: DataFrame, series: str, day: str | Column, value: str, least: int = 14, penalty: int = 40000) -> DataFrame:
    """One row per segment: the series, segment_no from 1, first_day (days since 1970), n_days, total, spread, cost, n_segments and best_cost (of the whole series, with penalties).

    day is a date or a timestamp, value a whole number; rows where one is null take no part, repeated rows count each, a null series is a series. A series goes from its first to its last day; days without rows
    count 0. One of fewer than 2 * least days is one segment. Cost of n values is n floor(1000 ln V), V = 1 + floor(variance), exact up to the logarithm, whatever the size of numbers; a total or spread beyond a long is given as its limit (a day's sum must fit one).
    Of equal cuts: the fewest segments, then the earliest starts, compared from the last segment backwards. An empty table gives no rows; other columns are ignored.
    """
    if least < 1 or penalty < 0:
        raise ValueError("least must be positive, and penalty not negative")
    day = F.col(day) if isinstance(day, str) else day
    taken = rows.select(F.col(series).alias("series"), F.unix_date(day.cast("date")).cast("long").alias("day"), F.col(value).cast("long").alias("x")).filter("day is not null and x is not null")
    daily = taken.groupBy("series", "day").agg(F.sum("x").alias("x"))
    whole = daily.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("days"))
    whole = whole.select("series", F.col("days")[0]["day"].alias("first"), F.transform("days", lambda d: d["day"]).alias("days"), F.transform("days", lambda d: d["x"]).alias("values"))

    def solve(batches):
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False)
            days, values = batch.column("days"), batch.column("values")
            ends = days.offsets.to_numpy()
            flat_days, flat = (x.values.to_numpy(zero_copy_only=False) for x in (days, values))
            by = defaultdict(list)
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                by[int(flat_days[b - 1] - flat_days[a]) + 1].append(i)
            for n, ids in by.items():
                each = max(1, min(STACK, TILE // max(n, 1)))
                for k in range(0, len(ids), each):
                    own = ids[k : k + each]
                    dense = np.zeros((len(own), n), np.int64)
                    for r, i in enumerate(own):
                        a, b = ends[i], ends[i + 1]
                        dense[r, flat_days[a:b] - flat_days[a]] = flat[a:b]
                    stack, of, out = Stack(dense, least, penalty), [], []
                    for r, i in enumerate(own):
                        found, count, best = stack.segments(r)
                        of += [i] * count
                        out += [(no, int(first[i]) + a, m, s, v, c, count, best) for no, (a, m, s, v, c) in enumerate(found, 1)]
                    columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*out), _OUT)]
                    yield pa.RecordBatch.from_arrays([batch.column("series").take(pa.array(of)), *columns], ["series", *(name for name, _ in _OUT)])

    kind = taken.schema["series"].dataType.simpleString()
    out = whole.mapInArrow(solve, f"series {kind}, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long")
    return out.withColumnRenamed("series", series)


def op13_change_points(spark, sf_dir: str) -> DataFrame:
    return change_points(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), "vendor_id", "shipped_at", "quantity")


#: One step for each position carries the list of keys ((sum, segments, predecessor) as one number) of the positions before it. For series of under a million days.
ORACLE = """
WITH RECURSIVE t AS (SELECT vendor_id, shipped_at::DATE - DATE '1970-01-01' AS day, sum(quantity)::BIGINT AS x FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
r AS (SELECT vendor_id, min(day) AS lo, max(day) AS hi FROM t GROUP BY vendor_id),
f AS (SELECT g.vendor_id, lo, g.day, coalesce(t.x, 0) AS x FROM (SELECT vendor_id, lo, unnest(range(lo, hi + 1)) AS day FROM r) g LEFT JOIN t ON t.vendor_id IS NOT DISTINCT FROM g.vendor_id AND t.day = g.day),
p AS (SELECT vendor_id, lo, day, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM f WINDOW w AS (PARTITION BY vendor_id ORDER BY day)),
a AS (SELECT vendor_id, lo, count(*) AS n, list_concat([0::HUGEINT], list(s ORDER BY day)) AS s, list_concat([0::HUGEINT], list(q ORDER BY day)) AS q FROM p GROUP BY vendor_id, lo),
d AS (SELECT vendor_id, lo, n, s, q, 0 AS j, [0::HUGEINT] AS key FROM a
  UNION ALL SELECT vendor_id, lo, n, s, q, j + 1, list_append(key, list_min(list_transform(list_filter(range(0, greatest(j - 12, 1)), lambda i: (i = 0 AND (j + 1 >= 14 OR j + 1 = n)) OR i >= 14),
    lambda i: (key[i + 1] // 1000000 + ((j + 1 - i) * floor(1000 * ln((1 + ((j + 1 - i) * (q[j + 2] - q[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // ((j + 1 - i) * (j + 1 - i)))::DOUBLE)) + CASE WHEN i > 0 THEN 40000 ELSE 0 END)::HUGEINT * 1000000 + 1) * 1000000 + i)))
  FROM d WHERE j < n),
b AS (SELECT vendor_id, lo, n, s, q, key, n AS e, (key[n + 1] % 1000000)::BIGINT AS i, 1 AS back FROM d WHERE j = n
  UNION ALL SELECT vendor_id, lo, n, s, q, key, i, (key[i + 1] % 1000000)::BIGINT, back + 1 FROM b WHERE i > 0),
g AS (SELECT *, e - i AS m, s[e + 1] - s[i + 1] AS total, q[e + 1] - q[i + 1] AS sq, count(*) OVER (PARTITION BY vendor_id) AS n_segments FROM b),
v AS (SELECT *, 1 + (m * sq - total * total) // (m * m) AS spread FROM g)
SELECT vendor_id, (n_segments - back + 1)::INT AS segment_no, (lo + i)::BIGINT AS first_day, m::BIGINT AS n_days, total::BIGINT AS total, spread::BIGINT AS spread, (m * floor(1000 * ln(spread::DOUBLE)))::BIGINT AS cost,
  n_segments, (key[n + 1] // 1000000000000)::BIGINT AS best_cost FROM v
"""
