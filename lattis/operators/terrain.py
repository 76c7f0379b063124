"""Terrain hydrology on cell tables: depression filling, D8 directions, accumulation, catchments, streams, boundaries."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .raster import Raster

#: Fixed values: (row step, column step, code) in the order that settles ties.
D8 = ((0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32), (-1, 0, 64), (-1, 1, 128))


def d8_flow_direction(r: Raster) -> DataFrame:
    """(row, col, direction): the code of the steepest descent, 0 without one. One shuffle: each cell sends its height to its
    neighbours, and every cell aggregates what it gets."""
    z = r.valid().select("row", "col", F.col("value").alias("z"))
    sends = F.array(*[F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(k).alias("k"), F.col("z").alias("z")) for k, (dr, dc, _) in enumerate(D8)], F.struct("row", "col", F.lit(8).alias("k"), "z"))
    got = z.select(F.explode(sends).alias("s")).select("s.*").groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in range(9)])
    drops = [(F.col("z8") - F.col(f"z{k}")) / (math.sqrt(2) if dr and dc else 1.0) for k, (dr, dc, _) in enumerate(D8)]
    best = F.greatest(*drops)
    code = F.lit(0)
    for k in range(7, -1, -1):
        code = F.when(drops[k] == best, D8[k][2]).otherwise(code)
    return got.where("z8 is not null").select("row", "col", F.when(best > 0, code).otherwise(0).cast("int").alias("direction"))


def receivers(direction: DataFrame, n_cols: int) -> DataFrame:
    """(cell, recv): recv is null for pits and where the target has no direction."""
    step = F.lit(None).cast("long")
    for dr, dc, c in D8:
        off_edge = (F.col("col") + dc < 0) | (F.col("col") + dc >= n_cols) | (F.col("row") + dr < 0)
        step = F.when((F.col("direction") == c) & ~off_edge, (F.col("row") + dr) * n_cols + F.col("col") + dc).otherwise(step)
    e = direction.select((F.col("row") * n_cols + F.col("col")).alias("cell"), step.alias("to"))
    return e.join(e.select(F.col("cell").alias("recv")), F.col("to") == F.col("recv"), "left").select("cell", "recv")


def flow_accumulation(recv: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(cell, acc): the weight of all cells upstream, itself included. Pointer doubling: log2(longest path) rounds, each one
    aggregation and two equi-joins, written to the shared folder."""
    s = recv.withColumn("acc", F.lit(1.0)) if weights is None else recv.join(weights, "cell", "left").withColumn("acc", F.coalesce("weight", F.lit(0.0))).drop("weight")
    s = stored(s)
    while s.where("recv is not null").take(1):
        got = s.where("recv is not null").groupBy(F.col("recv").alias("to")).agg(F.sum("acc").alias("more"))
        jump = s.select(F.col("cell").alias("via"), F.col("recv").alias("next"))
        s = s.join(got, F.col("cell") == F.col("to"), "left").join(jump, F.col("recv") == F.col("via"), "left")
        s = stored(s.select("cell", F.col("next").alias("recv"), (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc")))
    return s.select("cell", "acc")


def catchment(recv: DataFrame, outlet: int) -> DataFrame:
    """(cell, inside): whether a cell's water passes the outlet. Pointer doubling on reachability."""
    s = recv.withColumn("inside", F.col("cell") == outlet).withColumn("recv", F.when(F.col("cell") != outlet, F.col("recv")))
    s = stored(s)
    while s.where("recv is not null").take(1):
        jump = s.select(F.col("cell").alias("via"), F.col("recv").alias("next"), F.col("inside").alias("hit"))
        s = s.join(jump, F.col("recv") == F.col("via"), "left")
        s = stored(s.select("cell", F.col("next").alias("recv"), (F.col("inside") | F.coalesce("hit", F.lit(False))).alias("inside")))
    return s.select("cell", F.col("inside").cast("int").alias("inside"))


def downstream_paths(recv: DataFrame, starts: DataFrame, max_steps: int = 1 << 20) -> DataFrame:
    """(start, step, cell) from each start (column start) down, itself at step 0. Doubling: after round k the 2^k-step jumps
    extend every known step, so log2(length) joins."""
    path = starts.select("start", F.lit(0).cast("long").alias("step"), F.col("start").alias("cell"))
    jump, n = stored(recv.where("recv is not null")), 1
    path = stored(path)
    while n <= max_steps:
        more = path.join(jump.withColumnRenamed("cell", "at"), F.col("cell") == F.col("at")).select("start", (F.col("step") + n).alias("step"), F.col("recv").alias("cell"))
        if not more.take(1):
            break
        path = stored(path.union(more.where(F.col("step") <= max_steps)))
        far = jump.select(F.col("cell").alias("via"), F.col("recv").alias("next"))
        jump, n = stored(jump.join(far, F.col("recv") == F.col("via")).select("cell", F.col("next").alias("recv"))), 2 * n
    return path


def snap_pour_point(acc: DataFrame, row: int, col: int, n_rows: int, n_cols: int, search_cells: int = 3) -> tuple[int, int]:
    """The cell of the largest accumulation (cell, acc) in the window; ties by row, then column."""
    if not (0 <= row < n_rows and 0 <= col < n_cols):
        raise ValueError("the pour point lies outside the grid")
    a = acc.withColumn("row", F.expr(f"cell div {n_cols}")).withColumn("col", F.col("cell") % n_cols)
    near = a.where(F.col("row").between(row - search_cells, row + search_cells) & F.col("col").between(col - search_cells, col + search_cells) & F.col("acc").isNotNull())
    best = near.orderBy(F.desc("acc"), "row", "col").select("row", "col").first()
    return (best.row, best.col) if best else (row, col)


def _flood(t: pa.Table, eps: float) -> pa.Table:
    """One tile: heights relax from the seeds and from the cells around the tile."""
    row, col, z = (t.column(c).to_numpy() for c in ("row", "col", "z"))
    w, own, seed = (t.column(c).to_numpy(zero_copy_only=False) for c in ("w", "own", "seed"))
    at = {(r, c): i for i, (r, c) in enumerate(zip(row.tolist(), col.tolist(), strict=True))}
    new, heap = w.copy(), [(v, i) for i, v in enumerate(w.tolist()) if v < math.inf]
    for i in np.flatnonzero(seed & own).tolist():
        if z[i] < new[i]:
            new[i] = z[i]
            heap.append((z[i], i))
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        if v > new[i]:
            continue
        for dr, dc, _ in D8:
            j = at.get((row[i] + dr, col[i] + dc))
            if j is not None and own[j]:
                level = z[j] if z[j] > v else v + eps
                if level < new[j]:
                    new[j] = level
                    heapq.heappush(heap, (level, j))
    keep = pa.array(own)
    return pa.table({"row": t.column("row"), "col": t.column("col"), "z": t.column("z"), "seed": t.column("seed"), "w": pa.array(new), "changed": pa.array(new < w)}).filter(keep)


def fill_depressions(r: Raster, epsilon: float = 1e-4, tile: int = 512) -> DataFrame:
    """(row, col, value) with depressions raised by epsilon a cell towards their outlets.

    The filled surface is the least one with W = z on cells at the border or next to nodata and, elsewhere, W = z if z is above
    its lowest neighbour's W, else that plus epsilon. Tiles of bounded size flood alone from seeds and the ring of cells around
    them; rounds end when no tile changes. Any order of relaxation gives the same floats.
    """
    g = r.grid
    z = r.valid().select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("z"))
    near = z.select(F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc, _ in D8])).alias("s")).select("s.*").groupBy("row", "col").agg(F.count("*").alias("n"))
    s = z.join(near, ["row", "col"], "left").withColumn("seed", F.coalesce("n", F.lit(0)) < 8).drop("n").withColumn("w", F.lit(math.inf)).withColumn("changed", F.lit(True))
    assert g.rows and g.cols
    s = stored(s)
    while True:
        tr, tc = lambda c: F.floor(c / tile), lambda c: F.floor(c / tile)
        homes = F.array_distinct(F.array(*[F.struct(tr(F.col("row") + dr).alias("tr"), tc(F.col("col") + dc).alias("tc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]))
        dealt = s.withColumn("h", F.explode(homes)).select("row", "col", "z", "seed", "w", F.col("h.tr").alias("tr"), F.col("h.tc").alias("tc"))
        dealt = dealt.withColumn("own", (F.col("tr") == tr(F.col("row"))) & (F.col("tc") == tc(F.col("col"))))
        s = stored(dealt.groupBy("tr", "tc").applyInArrow(lambda t: _flood(t, epsilon), "row long, col long, z double, seed boolean, w double, changed boolean"))
        if not s.where("changed").take(1):
            return s.select("row", "col", F.col("w").alias("value"))


def boundary_edges(mask: DataFrame) -> DataFrame:
    """Unit edges (x0, y0, x1, y1 in cell corners) that occur once among the cells (row, col) of a mask: its outline."""
    c, r = F.col("col"), F.col("row")
    edge = lambda a, b, x, y: F.struct(a.alias("x0"), b.alias("y0"), x.alias("x1"), y.alias("y1"))
    e = mask.select(F.explode(F.array(edge(c, r, c + 1, r), edge(c, r + 1, c + 1, r + 1), edge(c, r, c, r + 1), edge(c + 1, r, c + 1, r + 1))).alias("e")).select("e.*")
    return e.groupBy("x0", "y0", "x1", "y1").count().where("count = 1").drop("count")


def mask_to_rings(mask: DataFrame) -> list[list[tuple[int, int]]]:
    """The outline of a mask as closed rings of corners, for export; edges reach the driver (as many as the perimeter)."""
    out: dict = {}
    for r in boundary_edges(mask).toLocalIterator():
        a, b = (r.x0, r.y0), (r.x1, r.y1)
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    rings = []
    while out:
        start = min(out)
        ring, at = [start], start
        while True:
            nxt = out[at].pop()
            out[nxt].remove(at)
            for p in (at, nxt):
                if not out[p]:
                    del out[p]
            at = nxt
            ring.append(at)
            if at == start:
                break
        rings.append(ring)
    return rings
