"""Pointy-top hexagon lattices in closed form: cells from a range, points to cells by arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: metres a second
SPEED_UNITS = {"knots": 0.514444, "mps": 1.0, "kph": 1 / 3.6}


def hex_area_from_radius(radius: float) -> float:
    return 1.5 * math.sqrt(3) * radius**2


def hex_radius_from_area(area: float) -> float:
    if area <= 0:
        raise ValueError("area must be positive")
    return math.sqrt(area / (1.5 * math.sqrt(3)))


def hex_radius_from_travel_time(speed: float, minutes: float, speed_units: str = "knots", divisor: float = 2) -> float:
    if speed_units not in SPEED_UNITS:
        raise ValueError(f"unknown speed unit {speed_units!r}")
    return speed * SPEED_UNITS[speed_units] * 60 * minutes / divisor


@dataclass(frozen=True)
class HexLattice:
    """Centres lie at (minx + col * width + (width / 2 in odd rows), miny + row * 1.5 * radius); ids go row by row."""

    minx: float
    miny: float
    radius: float
    n_rows: int
    n_cols: int
    crs: object = None
    box: tuple[float, float, float, float] | None = None

    @property
    def width(self) -> float:
        return math.sqrt(3) * self.radius

    @property
    def n_cells(self) -> int:
        return self.n_rows * self.n_cols

    @classmethod
    def over(cls, bounds: tuple[float, float, float, float], radius: float, crs: object = None, pad_cells: float = 1) -> HexLattice:
        if radius <= 0:
            raise ValueError("radius must be positive")
        if crs in (4326, 4269):
            raise ValueError("a hexagon lattice needs a metric crs")
        w, h = math.sqrt(3) * radius, 2 * radius
        x0, y0, x1, y1 = bounds[0] - pad_cells * w, bounds[1] - pad_cells * h, bounds[2] + pad_cells * w, bounds[3] + pad_cells * h
        return cls(x0, y0, radius, math.ceil((y1 - y0) / (1.5 * radius)) + 1, math.ceil((x1 - x0) / w) + 1, crs, tuple(bounds))

    @classmethod
    def for_points(cls, df: DataFrame, radius: float | None = None, area: float | None = None, x: str = "x", y: str = "y", crs: object = None, min_cells: int = 4) -> HexLattice:
        """The lattice over the extent of df's points: one aggregation. Small extents grow about their centre to min_cells."""
        if (radius is None) == (area is None):
            raise ValueError("give either radius or area")
        radius = radius if radius is not None else hex_radius_from_area(area)
        x0, y0, x1, y1 = (float(v) for v in df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())
        need, have = min_cells * hex_area_from_radius(radius), (x1 - x0) * (y1 - y0)
        if have < need:
            f = math.sqrt(1.1 * need / have) if have > 0 else 1.0
            cx, cy, hw, hh = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2 * f, (y1 - y0) / 2 * f
            x0, y0, x1, y1 = cx - hw, cy - hh, cx + hw, cy + hh
        return cls.over((x0, y0, x1, y1), radius, crs)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.minx) + col * self.width + (row % 2) * (self.width / 2), F.lit(self.miny) + row * (1.5 * self.radius)

    def cells(self, spark: SparkSession, clip: bool = False) -> DataFrame:
        """hex_id, row, col, centroid_x, centroid_y of every cell. clip keeps those that touch the unpadded box and numbers them anew."""
        df = spark.range(self.n_cells).withColumnRenamed("id", "hex_id")
        df = df.withColumn("row", F.expr(f"hex_id div {self.n_cols}")).withColumn("col", F.col("hex_id") % self.n_cols)
        cx, cy = self.centre(F.col("row"), F.col("col"))
        df = df.withColumns({"centroid_x": cx, "centroid_y": cy})
        if not clip:
            return df
        df = df.where(self._touches(F.col("centroid_x"), F.col("centroid_y"))).drop("hex_id")
        # new ids without one global sort of rows: counts of the rows before, then places within the row
        per = df.groupBy("row").agg(F.count("*").alias("n"), F.min("col").alias("c0"))
        before = per.alias("a").join(per.alias("b"), F.expr("b.row < a.row"), "left").groupBy("a.row").agg(F.first("a.c0").alias("c0"), F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
        return df.join(before, "row").select((F.col("before") + F.col("col") - F.col("c0")).alias("hex_id"), "row", "col", "centroid_x", "centroid_y")

    def _touches(self, cx: Column, cy: Column) -> Column:
        """Separating axes of a hexagon and the box: x, y and the two slanted edge normals."""
        x0, y0, x1, y1 = self.box
        bx, by, hx, hy = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
        r, w = self.radius, self.width / 2
        dx, dy, s = cx - bx, cy - by, math.sqrt(3) / 2
        out = (F.abs(dx) <= hx + w) & (F.abs(dy) <= hy + r)
        for sign in (1, -1):
            out &= F.abs(dx * 0.5 + dy * (sign * s)) <= hx * 0.5 + hy * s + w
        return out

    def place(self, df: DataFrame, x: str = "x", y: str = "y", out: str = "hex_id") -> DataFrame:
        """df with the hex_id of each point: the nearest centre of the two candidate rows, the smaller id on a tie; null
        outside the lattice. Steps are columns of their own, so each is computed once."""
        h, half = 1.5 * self.radius, self.width / 2
        df = df.withColumn("__r0", F.floor((F.col(y) - self.miny) / h))
        df = df.withColumns({"__s0": F.lit(self.minx) + F.pmod("__r0", F.lit(2)) * half, "__s1": F.lit(self.minx) + F.pmod(F.col("__r0") + 1, F.lit(2)) * half})
        df = df.withColumns({f"__c{k}": F.ceil((F.col(x) - F.col(f"__s{k}")) / self.width - 0.5) for k in (0, 1)})
        for k in (0, 1):
            dx, dy = F.col(x) - (F.col(f"__s{k}") + F.col(f"__c{k}") * self.width), F.col(y) - (F.lit(self.miny) + (F.col("__r0") + k) * h)
            df = df.withColumn(f"__d{k}", dx * dx + dy * dy)
        df = df.withColumns({"__row": F.expr("if(__d0 <= __d1, __r0, __r0 + 1)"), "__col": F.expr("if(__d0 <= __d1, __c0, __c1)")})
        inside = (F.col("__row") >= 0) & (F.col("__row") < self.n_rows) & (F.col("__col") >= 0) & (F.col("__col") < self.n_cols)
        df = df.withColumn(out, F.when(inside, F.col("__row") * self.n_cols + F.col("__col")))
        return df.drop("__r0", "__s0", "__s1", "__c0", "__c1", "__d0", "__d1", "__row", "__col")

    def vertices(self, cx: Column, cy: Column) -> Column:
        """The closed ring of a cell as an array of (x, y)."""
        pts = [F.struct((cx + self.radius * math.cos(math.radians(30 + 60 * k))).alias("x"), (cy + self.radius * math.sin(math.radians(30 + 60 * k))).alias("y")) for k in (*range(6), 0)]
        return F.array(*pts)

    def neighbours(self, cells: DataFrame) -> DataFrame:
        """Edges (i, j) between cells that share a side; closed form, the lattice's own ids."""
        # offsets (row, col) of even and of odd rows
        even, odd = [(0, -1), (0, 1), (-1, -1), (-1, 0), (1, -1), (1, 0)], [(0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, 1)]
        arr = lambda o: F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in o])
        e = cells.select("hex_id", "row", "col", F.explode(F.when(F.col("row") % 2 == 0, arr(even)).otherwise(arr(odd))).alias("o"))
        e = e.select(F.col("hex_id").alias("i"), (F.col("row") + F.col("o.dr")).alias("r"), (F.col("col") + F.col("o.dc")).alias("c"))
        return e.where((F.col("r") >= 0) & (F.col("r") < self.n_rows) & (F.col("c") >= 0) & (F.col("c") < self.n_cols)).select("i", (F.col("r") * self.n_cols + F.col("c")).alias("j"))
