"""Rasters as cell tables (row, col, value): grids, mosaics, clipping, sampling, lines and zones."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import aggregate_expr, in_ring


@dataclass(frozen=True)
class GridSpec:
    """x = a * col + b * row + c, y = d * col + e * row + f for cell corners."""

    rows: int
    cols: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    crs: object = None
    nodata: float | None = None

    @classmethod
    def from_bounds(cls, rows: int, cols: int, bounds: tuple[float, float, float, float], crs=None, nodata=None) -> GridSpec:
        x0, y0, x1, y1 = bounds
        return cls(rows, cols, (x1 - x0) / cols, 0.0, x0, 0.0, -(y1 - y0) / rows, y1, crs, nodata)

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.a), abs(self.e)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = [self.a * i + self.b * j + self.c for i in (0, self.cols) for j in (0, self.rows)]
        ys = [self.d * i + self.e * j + self.f for i in (0, self.cols) for j in (0, self.rows)]
        return min(xs), min(ys), max(xs), max(ys)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        r, c = row + 0.5, col + 0.5
        return c * self.a + r * self.b + self.c, c * self.d + r * self.e + self.f

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of the cell that holds a point, by the inverse transform."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c, y - self.f
        return F.floor((dy * self.a - dx * self.d) / det), F.floor((dx * self.e - dy * self.b) / det)


@dataclass(frozen=True)
class Raster:
    cells: DataFrame
    grid: GridSpec

    def valid(self) -> DataFrame:
        """Cells whose value is finite and not nodata."""
        v = F.col("value")
        ok = v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) != float("inf"))
        return self.cells.where(ok & (v != self.grid.nodata) if self.grid.nodata is not None and self.grid.nodata == self.grid.nodata else ok)

    def with_cells(self, cells: DataFrame) -> Raster:
        return replace(self, cells=cells)


def raster_from_array(spark: SparkSession, data, bounds, crs=None, nodata=None) -> Raster:
    rows, cols = data.shape
    cells = spark.createDataFrame([(r, c, float(data[r, c])) for r in range(rows) for c in range(cols)], "row long, col long, value double")
    return Raster(cells, GridSpec.from_bounds(rows, cols, bounds, crs, nodata))


def to_points(r: Raster, name: str = "value", drop_nodata: bool = True) -> DataFrame:
    x, y = r.grid.centre(F.col("row"), F.col("col"))
    return (r.valid() if drop_nodata else r.cells).withColumns({"x": x, "y": y}).withColumnRenamed("value", name)


def merge(rasters: list[Raster]) -> Raster:
    """The union of extents on the first raster's lattice; of several values in a cell, the first raster's valid one."""
    g = rasters[0].grid
    boxes = [r.grid.bounds for r in rasters]
    x0, y1 = min(b[0] for b in boxes), max(b[3] for b in boxes)
    cols, rows = round((max(b[2] for b in boxes) - x0) / g.a), round((min(b[1] for b in boxes) - y1) / g.e)
    parts = []
    for k, r in enumerate(rasters):
        dr, dc = round((r.grid.f - y1) / g.e), round((r.grid.c - x0) / g.a)
        parts.append(r.valid().select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "value", F.lit(k).alias("k")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return Raster(all_.groupBy("row", "col").agg(F.min_by("value", "k").alias("value")), replace(g, rows=rows, cols=cols, c=x0, f=y1))


def clip(r: Raster, ring: list[tuple[float, float]]) -> Raster:
    """Cells whose centre lies in the ring, cropped to its box; others become absent."""
    x, y = r.grid.centre(F.col("row"), F.col("col"))
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    g = r.grid
    c0, c1 = max(0, int((min(xs) - g.c) // g.a)), min(g.cols, -int(-(max(xs) - g.c) // g.a))
    r0, r1 = max(0, int((max(ys) - g.f) // g.e)), min(g.rows, -int(-(min(ys) - g.f) // g.e))
    cells = r.cells.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)).where(in_ring(x, y, ring))
    cells = cells.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "value")
    return Raster(cells, replace(g, rows=r1 - r0, cols=c1 - c0, c=g.c + c0 * g.a, f=g.f + r0 * g.e))


def sample_points(r: Raster, points: DataFrame, out: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """points with the value of the cell that holds them; null outside and on nodata."""
    row, col = r.grid.index(F.col(x), F.col(y))
    v = r.valid().select(F.col("row").alias("v_row"), F.col("col").alias("v_col"), F.col("value").alias(out))
    return points.withColumns({"p_row": row, "p_col": col}).join(v, (F.col("p_row") == F.col("v_row")) & (F.col("p_col") == F.col("v_col")), "left").drop("p_row", "p_col", "v_row", "v_col")


def line_vertices(lines: DataFrame, id_column: str = "line_id", path: str = "path", densify_every: float | None = None) -> DataFrame:
    """(id, vertex_index, x, y) of each line's vertices; segments longer than densify_every are cut into equal parts."""
    seg = lines.select(id_column, F.posexplode(path).alias("k", "p"), F.col(path).alias("pts"))
    seg = seg.select(id_column, "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.expr("get(pts, k + 1)").alias("q"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("q.x") - F.col("x"), F.col("q.y") - F.col("y")) / densify_every)) if densify_every else F.lit(1)
    seg = seg.withColumn("n", F.when(F.col("q").isNull(), 1).otherwise(n).cast("int"))
    seg = seg.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("j") / F.col("n")
    v = seg.select(id_column, "k", "j", (F.col("x") + F.coalesce(t * (F.col("q.x") - F.col("x")), F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce(t * (F.col("q.y") - F.col("y")), F.lit(0.0))).alias("y"))
    return v.withColumn("vertex_index", F.expr(f"row_number() over (partition by {id_column} order by k, j) - 1")).select(id_column, "vertex_index", "x", "y")


def sample_lines(r: Raster, lines: DataFrame, id_column: str = "line_id", stats=("mean", "min", "max"), name: str = "value", densify_every: float | None = None) -> DataFrame:
    v = sample_points(r, line_vertices(lines, id_column, densify_every=densify_every), name)
    agg = v.groupBy(id_column).agg(*[aggregate_expr(s, name).alias(f"{name}_{s}") for s in stats])
    return lines.join(agg, id_column, "left")


def line_profile(r: Raster, lines: DataFrame, step: float, id_column: str = "line_id", path: str = "path") -> DataFrame:
    """Values at distances 0, step, 2 step, ... up to each line's length."""
    s = lines.select(id_column, F.posexplode(path).alias("k", "p"), F.col(path).alias("pts")).withColumn("q", F.expr("get(pts, k + 1)")).where("q is not null")
    s = s.select(id_column, "k", "p", "q", F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")).alias("len"))
    s = s.withColumn("to", F.expr(f"sum(len) over (partition by {id_column} order by k)")).withColumn("from", F.col("to") - F.col("len"))
    s = s.withColumn("last", F.expr(f"k = max(k) over (partition by {id_column})"))
    s = s.where(F.expr(f"floor(to / {step}) >= ceil(from / {step})"))
    s = s.withColumn("m", F.explode(F.expr(f"sequence(cast(ceil(from / {step}) as bigint), cast(floor(to / {step}) as bigint))")))
    s = s.withColumn("distance", F.col("m") * F.lit(float(step))).where("distance < to or last")
    t = (F.col("distance") - F.col("from")) / F.col("len")
    pts = s.select(id_column, "distance", (F.col("p.x") + t * (F.col("q.x") - F.col("p.x"))).alias("x"), (F.col("p.y") + t * (F.col("q.y") - F.col("p.y"))).alias("y"))
    return sample_points(r, pts)


def zonal_statistics(zones: DataFrame, r: Raster, stats=("mean", "min", "max", "std", "median", "sum", "count"), prefix: str = "", id_column: str = "zone_id") -> DataFrame:
    """zones (id and box x0, y0, x1, y1) with statistics of the valid cells whose centres they hold; of overlapping zones the
    one with the largest id has a cell. Boxes become ranges of rows, joined on the row."""
    g = r.grid
    z = zones.select(F.col(id_column).alias("z"), "x0", "y0", "x1", "y1")
    row = lambda y: (y - g.f) / g.e - 0.5
    lo, hi = F.ceil(F.least(row(F.col("y0")), row(F.col("y1")))), F.floor(F.greatest(row(F.col("y0")), row(F.col("y1"))))
    z = z.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("z_row", F.explode(F.sequence("lo", "hi")))
    x, _ = g.centre(F.col("row"), F.col("col"))
    hit = r.valid().withColumn("cx", x).join(z, (F.col("row") == F.col("z_row")) & (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")))
    one = hit.groupBy("row", "col").agg(F.max("z").alias(id_column), F.first("value").alias("value"))
    agg = one.groupBy(id_column).agg(*[aggregate_expr(s, "value").alias(f"{prefix}{s}") for s in stats])
    out = zones.join(agg, id_column, "left")
    return out.withColumn(f"{prefix}count", F.coalesce(f"{prefix}count", F.lit(0).cast("long"))) if "count" in stats else out
