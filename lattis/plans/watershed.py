"""Hydrology: elevation tiles -> filled surface -> directions -> accumulation -> catchment, streams and flowlines."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster, terrain
from ..operators.raster import Raster
from ..runtime import stored


@dataclass
class Watershed:
    """direction: row, col, direction. accumulation: cell, acc. inside: cell, inside (0 or 1). A cell is row * columns + column."""

    dem: Raster
    filled: Raster
    direction: DataFrame
    accumulation: DataFrame
    inside: DataFrame
    outlet: tuple[int, int]
    stream_cells: float
    lines: DataFrame | None = None
    stats: dict[str, float] = field(default_factory=dict)

    def streams(self) -> DataFrame:
        """(cell, acc) of cells with at least the threshold's accumulation."""
        return self.accumulation.where(F.col("acc") >= self.stream_cells)

    def as_raster(self, cells: DataFrame, value: str) -> Raster:
        """A (cell, value) table on the elevation grid."""
        n = self.dem.grid.cols
        return self.dem.with_cells(cells.select(F.expr(f"cell div {n}").alias("row"), (F.col("cell") % n).alias("col"), F.col(value).cast("double").alias("value")))


def load_dem(tiles: list[Raster], boundary: list[tuple[float, float]] | None = None) -> Raster:
    """The mosaic of the tiles, clipped to a ring if there is one."""
    if not tiles:
        raise ValueError("no elevation tiles")
    dem = raster.merge(tiles) if len(tiles) > 1 else tiles[0]
    return raster.clip(dem, boundary) if boundary else dem


def delineate(dem: Raster, pour_point: tuple[float, float], stream_cells: float | None = None, snap_cells: int = 5, epsilon: float = 1e-4) -> Watershed:
    """The catchment above a pour point (x, y in the grid's system). Streams hold 1 % of the grid's cells (50 at least) unless told."""
    g = dem.grid
    filled = dem.with_cells(stored(terrain.fill_depressions(dem, epsilon)))
    direction = stored(terrain.d8_flow_direction(filled))
    recv = stored(terrain.receivers(direction, g.cols))
    acc = terrain.flow_accumulation(recv)
    at = dem.cells.sparkSession.range(1).select(*[c.alias(n) for c, n in zip(g.index(F.lit(float(pour_point[0])), F.lit(float(pour_point[1]))), ("row", "col"), strict=True)]).first()
    row, col = terrain.snap_pour_point(acc, int(at.row), int(at.col), g.rows, g.cols, snap_cells)
    inside = terrain.catchment(recv, row * g.cols + col)
    size, threshold = g.rows * g.cols, float(stream_cells or max(50, g.rows * g.cols // 100))
    n_in = inside.agg(F.sum("inside")).first()[0] or 0
    a = acc.agg(F.max(F.when(F.col("cell") == row * g.cols + col, F.col("acc"))).alias("out"), F.sum((F.col("acc") >= threshold).cast("long")).alias("n")).first()
    z = dem.valid().agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    area = abs(g.a * g.e - g.b * g.d)
    stats = {
        "dem_cells": float(size), "catchment_cells": float(n_in), "catchment_area_km2": n_in * area / 1e6, "outlet_accumulation_cells": float(a.out or 0), "stream_threshold_cells": threshold,
        "stream_cells": float(a.n or 0), "min_elevation": z.lo, "max_elevation": z.hi,
    }
    return Watershed(dem, filled, direction, acc, inside, (row, col), threshold, None, stats)


def flowlines(w: Watershed, n_lines: int = 12, min_cells: int = 15, seed: int = 0) -> DataFrame:
    """(line_id, path): the ways down from n_lines stream heads in the catchment, drawn by hash order. Heads are the stream cells
    up to the 40th percentile of accumulation; ways of fewer than min_cells cells are left out."""
    here = stored(w.streams().join(w.inside.where("inside = 1"), "cell", "left_semi"))
    cut = here.agg(F.percentile("acc", F.lit(0.4))).first()[0]
    heads = here.where(F.col("acc") <= F.lit(cut).cast("double")).orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(n_lines).select(F.col("cell").alias("start"))
    steps = terrain.downstream_paths(stored(terrain.receivers(w.direction, w.dem.grid.cols)), heads)
    n = w.dem.grid.cols
    x, y = w.dem.grid.centre(F.expr(f"cell div {n}"), F.col("cell") % n)
    # a way is one line of export, as long as the grid's longest stream; there are n_lines of them
    ways = steps.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("step", x.alias("x"), y.alias("y")))).alias("p"))
    return ways.where(F.size("p") >= min_cells).select(F.col("start").alias("line_id"), F.expr("transform(p, q -> struct(q.x as x, q.y as y))").alias("path"))


def with_elevations(lines: DataFrame, dem: Raster, id_column: str = "line_id", densify_every: float | None = None) -> DataFrame:
    """lines with elevation_mean, _min, _max, length_km and slope_m_per_km (the range of heights by length; null without length)."""
    out = raster.sample_lines(dem, lines, id_column, ("mean", "min", "max"), "elevation", densify_every or min(dem.grid.resolution))
    leg = "aggregate(sequence(1, size(path) - 1), 0D, (s, i) -> s + hypot(get(path, i).x - get(path, i - 1).x, get(path, i).y - get(path, i - 1).y))"
    out = out.withColumn("length_km", F.expr(f"if(size(path) > 1, {leg}, 0D) / 1000"))
    return out.withColumn("slope_m_per_km", F.expr("(elevation_max - elevation_min) / nullif(length_km, 0)"))


def run_watershed(tiles: list[Raster], pour_point: tuple[float, float], boundary=None, lines: DataFrame | None = None, line_id: str = "line_id", n_lines: int = 12, min_cells: int = 15, **options) -> Watershed:
    """The whole workflow; lines stands for flowlines that are known, else they are traced. Catchment heights are added where there
    are lines."""
    w = delineate(load_dem(tiles, boundary), pour_point, **options)
    lines = lines if lines is not None else flowlines(w, n_lines, min_cells)
    w.lines = stored(with_elevations(lines, w.filled, line_id))
    if w.lines.take(1):
        n = w.dem.grid.cols
        z = w.filled.valid().select((F.col("row") * n + F.col("col")).alias("cell"), "value").join(w.inside.where("inside = 1"), "cell", "left_semi")
        m = z.agg(F.avg("value"), F.min("value"), F.max("value")).first()
        w.stats |= {f"catchment_elev_{k}": v for k, v in zip(("mean", "min", "max"), m, strict=True)}
    return w


def outline(w: Watershed) -> list[list[tuple[float, float]]]:
    """The catchment's rings in the grid's coordinates."""
    g, n = w.dem.grid, w.dem.grid.cols
    rings = terrain.mask_to_rings(w.inside.where("inside = 1").select(F.expr(f"cell div {n}").alias("row"), (F.col("cell") % n).alias("col")))
    return [[(g.a * c + g.b * r + g.c, g.d * c + g.e * r + g.f) for c, r in ring] for ring in rings]


def export(w: Watershed, folder: str, name: str = "watershed") -> dict[str, str]:
    """A bundle of styled layers: heights, log accumulation and catchment as rasters; the outlet and line vertices as points."""
    from ..sources.qgis import QgisBundle

    spark, g = w.dem.cells.sparkSession, w.dem.grid
    b = QgisBundle(os.path.join(folder, "qgis"), name)
    b.add_raster(w.dem, "dem").add_raster(w.as_raster(w.accumulation.withColumn("acc", F.log1p("acc")), "acc"), "flow_accumulation_log").add_raster(w.as_raster(w.inside, "inside"), "catchment_mask", discrete=True)
    x, y = g.centre(F.lit(w.outlet[0]), F.lit(w.outlet[1]))
    b.add_points(spark.range(1).select(F.lit("outlet").alias("name"), x.alias("x"), y.alias("y"), F.lit(w.stats["outlet_accumulation_cells"]).alias("accumulation_cells")), "outlet")
    if w.lines is not None:
        pts = raster.line_vertices(w.lines).join(w.lines.drop("path"), "line_id")
        b.add_points(pts, "flowlines", graduated="elevation_mean")
    b.write()
    return {"qgis": b.folder}
