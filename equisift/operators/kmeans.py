"""K-means in all cells and from all starts at once.

A pass reads each row once. A task holds its rows against the centroids of all starts of their cell and sends one row for each cell and start: counts, sums and cost of its clusters. What is kept between passes is
the centroids alone (cells * starts * k vectors; cells are few), so rows are never written, multiplied or shuffled, and a lost executor costs its tasks only. Starts that have settled leave the passes, and with
the last start of a cell the cell's rows leave the scan.

Seeding is uniform, or k-means||: rounds of draws in proportion to the squared distance from what is drawn already, each of `draw` rows at once (an exponential race, so a round is one pass and draws that many
whatever the scale of the distances), then k picks among the candidates, weighted by the rows nearest to each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rng import uniform, uniform_value

DIGITS = 9
#: Rows whose distances are made at once.
SLICE = 2048

#: By cell, by start: a matrix of centroids.
Centres = dict[str, dict[int, np.ndarray]]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rounded distances of rows from centroids, so that ties are ties however sums are ordered."""
    return np.column_stack([np.round(np.sqrt(((x - row) ** 2).sum(1)), DIGITS) for row in c])


def _cells(batch: pa.RecordBatch, names: list) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(cell, places, vectors) of a batch."""
    sg = np.array(batch.column("sg").to_pylist(), object)
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    v = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
    found = ((name, np.flatnonzero(sg == name)) for name in names)
    return [(name, at, v[at]) for name, at in found if len(at)]


def _summed(rows: DataFrame, centres: Centres) -> dict:
    """By (cell, start): counts, sums and cost (of squared distances) of the clusters; a row counts with its nearest centroid (ties: the first)."""

    def part(batches):
        total = {(name, s): [np.zeros(len(c)), np.zeros(c.shape), 0.0] for name, own in centres.items() for s, c in own.items()}
        for batch in batches:
            for name, _, v in _cells(batch, list(centres)):
                for a in range(0, len(v), SLICE):
                    x = v[a : a + SLICE]
                    for s, c in centres[name].items():
                        d = _distances(x, c)
                        near = d.argmin(1)
                        sums = total[name, s]
                        sums[0] += np.bincount(near, minlength=len(c))
                        sums[1] += (near == np.arange(len(c))[:, None]).astype(float) @ x
                        sums[2] += float((d[np.arange(len(x)), near] ** 2).sum())
        keys = [k for k, t in total.items() if t[0].any()]
        if keys:
            n, sums, cost = zip(*(total[k] for k in keys))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([list(x) for x in n]), pa.array([list(x.ravel()) for x in sums]), pa.array(list(cost))], _SUMS)

    def whole(key, table):
        """One row for each task, of a cell and start."""
        n, sums = (np.array(table.column(c).to_pylist()).sum(0) for c in ("n", "sums"))
        return pa.table([[key[0].as_py()], pa.array([key[1].as_py()], pa.int32()), [n.tolist()], [sums.tolist()], [float(np.sum(table.column("cost").to_numpy()))]], _SUMS)

    some = rows.select("sg", "v").filter(F.col("sg").isin(*centres))
    found = some.mapInArrow(part, _KINDS).groupBy("sg", "start").applyInArrow(whole, _KINDS).collect()
    return {(r["sg"], r["start"]): (np.array(r["n"]), np.array(r["sums"]).reshape(len(r["n"]), -1), r["cost"]) for r in found}


_SUMS = ["sg", "start", "n", "sums", "cost"]
_KINDS = "sg string, start int, n array<double>, sums array<double>, cost double"


def _raced(rows: DataFrame, seed: int, tags: list[tuple[str, str]], take: int, centres: Centres | None = None) -> dict:
    """By (cell, start): [(row_id, vector)] of the `take` rows that come first: by a uniform, or, with centres, by -ln(uniform) over the squared distance from the nearest of them (rows on one are left out). tags: the
    name and round of each start's uniforms. A task sends `take` rows of a cell and start at most."""
    kind = rows.schema["row_id"].dataType.simpleString()

    def part(batches):
        best: dict = {}
        for batch in batches:
            ids, u = batch.column("row_id"), batch.column("u").flatten().to_numpy().reshape(batch.num_rows, -1)
            names = list(centres) if centres is not None else [x for x in pc.unique(batch.column("sg")).to_pylist() if x is not None]
            for name, at, v in _cells(batch, names):
                own = ids.take(pa.array(at)).to_pylist()
                for s in range(len(tags)):
                    key = u[at, s]
                    if centres is not None:
                        d = np.concatenate([_distances(v[a : a + SLICE], centres[name][s]).min(1) for a in range(0, len(v), SLICE)])
                        with np.errstate(divide="ignore"):
                            key = np.where(d > 0, -np.log(key) / (d * d), np.inf)
                    floor = np.partition(key, take - 1)[take - 1] if take < len(key) else np.inf
                    new = [(key[i], own[i], v[i]) for i in np.flatnonzero((key <= floor) & (key < np.inf))]
                    best[name, s] = sorted(best.get((name, s), []) + new, key=lambda x: x[:2])[:take]
        out = [(name, s, *x) for (name, s), own in best.items() for x in own]
        if out:
            sg, start, key, row_id, v = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(sg), pa.array(start, pa.int32()), pa.array(key), pa.array(row_id, type=ids.type), pa.array([x.tolist() for x in v], pa.list_(pa.float64()))], ["sg", "start", "key", "row_id", "v"])

    some = rows.select("sg", "row_id", "v", F.array(*[uniform(seed, tag, n) for tag, n in tags]).alias("u"))
    if centres is not None:
        some = some.filter(F.col("sg").isin(*centres))
    order = Window.partitionBy("sg", "start").orderBy("key", "row_id")
    first = some.mapInArrow(part, f"sg string, start int, key double, row_id {kind}, v array<double>").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= take)
    out: dict = {}
    for r in sorted(first.collect(), key=lambda r: (r["sg"], r["start"], r["place"])):
        out.setdefault((r["sg"], r["start"]), []).append((r["row_id"], np.array(r["v"])))
    return out


def uniform_seeds(rows: DataFrame, k: int, seed: int, starts: int) -> Centres:
    """k rows of each cell in the order of a uniform of the start; a cell of fewer rows has fewer."""
    out: Centres = {}
    for (name, s), own in _raced(rows, seed, [("kmeans", s) for s in range(starts)], k).items():
        out.setdefault(name, {})[s] = np.array([v for _, v in own])
    return out


def candidates(rows: DataFrame, seed: int, starts: int, rounds: int, draw: int) -> dict:
    """By (cell, start): [(row_id, vector, weight)] by id: one row in uniform order, then `draw` rows of each round. The weight is the number of rows nearest to it."""
    found = _raced(rows, seed, [("kmeans", s) for s in range(starts)], 1)

    def centres() -> Centres:
        out: Centres = {}
        for (name, s), own in found.items():
            own.sort(key=lambda x: x[0])
            out.setdefault(name, {})[s] = np.array([v for _, v in own])
        return out

    for r in range(1, rounds + 1):
        for key, own in _raced(rows, seed, [("seeding", f"{s}.{r}") for s in range(starts)], draw, centres()).items():
            found[key] += own
    weights = _summed(rows, centres())
    return {key: [(i, v, float(w)) for (i, v), w in zip(own, weights[key][0])] for key, own in found.items()}


def picked(own: list[tuple], k: int, seed: int, start: int) -> list[tuple]:
    """k of the candidates, the first in proportion to weight, the next to weight times squared distance from those picked; fewer if no distance is left."""
    ids, v, w = [x[0] for x in own], np.array([x[1] for x in own]), np.array([x[2] for x in own])
    near, out = None, []
    for step in range(k):
        mass = w if near is None else w * near * near
        u = np.array([uniform_value(seed, "picks", f"{start}.{step}", i) for i in ids])
        with np.errstate(divide="ignore"):
            key = np.where(mass > 0, -np.log(u) / mass, np.inf)
        at = int(key.argmin())
        if key[at] == np.inf:
            break
        out.append(own[at])
        d = _distances(v, v[at : at + 1])[:, 0]
        near = d if near is None else np.minimum(near, d)
    return out


def parallel_seeds(rows: DataFrame, k: int, seed: int, starts: int, rounds: int = 2, draw: int | None = None) -> Centres:
    """k-means||: rounds + 2 passes for all cells and starts. A round draws 2 k rows unless told otherwise."""
    out: Centres = {}
    for (name, s), own in candidates(rows, seed, starts, rounds, draw or 2 * k).items():
        out.setdefault(name, {})[s] = np.array([x[1] for x in picked(own, k, seed, s)])
    return out


def run(rows: DataFrame, centres: Centres, rounds: int) -> tuple[Centres, dict]:
    """(centroids, cost by (cell, start)) once no centroid of a start moves, or after so many rounds. An empty cluster keeps its centroid; means are rounded to 9 digits."""
    centres = {name: dict(own) for name, own in centres.items()}
    active, cost = {(name, s) for name, own in centres.items() for s in own}, {}

    def left() -> Centres:
        out: Centres = {}
        for name, s in active:
            out.setdefault(name, {})[s] = centres[name][s]
        return out

    for _ in range(rounds):
        if not active:
            break
        for (name, s), (n, sums, of_old) in _summed(rows, left()).items():
            old = centres[name][s]
            new = np.where(n[:, None] > 0, np.round(sums / np.maximum(n, 1)[:, None], DIGITS), old)
            if np.array_equal(new, old):
                active.discard((name, s))
                cost[name, s] = of_old
            centres[name][s] = new
    if active:
        cost |= {key: c for key, (_, _, c) in _summed(rows, left()).items()}
    return centres, {key: round(c, DIGITS - 3) for key, c in cost.items()}


def best_starts(cost: dict) -> dict[str, int]:
    """The start of least cost in each cell (ties: the first)."""
    out: dict[str, int] = {}
    for name, s in sorted(cost, key=lambda key: (cost[key], key[1])):
        out.setdefault(name, s)
    return out
