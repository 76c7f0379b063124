"""Oceanography: gridded acquisitions -> hexagon series -> seasonal covariates -> local statistics."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import HexLattice
from ..operators import seasonal, spatial
from ..operators.seasonal import SeasonCalendar
from ..runtime import stored


@dataclass
class Covariates:
    """series: hex_id, year, doy, value. table: hex_id, centroid_x, centroid_y and a column a covariate."""

    lattice: HexLattice
    series: DataFrame
    season_means: DataFrame
    changes: DataFrame
    table: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c not in ("hex_id", "centroid_x", "centroid_y")]

    def missing(self) -> DataFrame:
        return seasonal.missingness(self.table)


def spacing(points: DataFrame, x: str = "x") -> float | None:
    """The least distance between different coordinates of a gridded layer, from its distinct values."""
    d = points.select(x).distinct().where(F.col(x).isNotNull())
    # neighbours in one window over bounded blocks: the value before a block's first is the largest of the blocks before
    lim = d.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if lim.lo is None or lim.lo == lim.hi:
        return None
    b = d.withColumn("b", F.floor((F.col(x) - lim.lo) / (lim.hi - lim.lo) * 1024))
    gaps = b.selectExpr(f"`{x}` - lag(`{x}`) over (partition by b order by `{x}`) as g").where("g > 0")
    ends = b.groupBy("b").agg(F.min(x).alias("a"), F.max(x).alias("z"))  # 1,025 rows at most
    between = ends.selectExpr("a - lag(z) over (order by b) as g").where("g > 0")
    return gaps.unionByName(between).agg(F.min("g")).first()[0]


def hex_series(points: DataFrame, lattice: HexLattice) -> DataFrame:
    """The mean of each hexagon and acquisition from points in long form (x, y, year, doy, value): one shuffle, partial first."""
    p = lattice.place(points).withColumn("hex_id", F.coalesce("hex_id", F.lit(-1).cast("long")))
    return p.groupBy("hex_id", "year", "doy").agg(F.avg("value").alias("value")).where("hex_id >= 0")


def build_covariates(points: DataFrame, radius: float | None = None, area: float | None = None, calendar: SeasonCalendar = SeasonCalendar(), crs: object = None) -> Covariates:
    """Per hexagon with points: <season>_mean and total_mean (climatology), <season>_var (variance of the relative change from year
    to year) and <year>_var (its variance within a year). The radius is three grid steps unless told."""
    if radius is None and area is None:
        radius = 3 * (spacing(points) or 55_500.0)
    lattice = HexLattice.for_points(points, radius=radius, area=area, crs=crs)
    series = stored(hex_series(points, lattice))
    ids = ["hex_id"]
    means = stored(seasonal.year_season_means(series, ids, calendar))
    changes = stored(seasonal.year_over_year(means, ids))
    years = [r[0] for r in series.select("year").distinct().orderBy("year").collect()]  # a row a year
    wide = seasonal.seasonal_means(means, ids).groupBy(*ids).pivot("season", [*calendar.seasons, "total"]).agg(F.first("mean"))
    wide = wide.select(*ids, *[F.col(s).alias(f"{s}_mean") for s in (*calendar.seasons, "total")])
    for table, key, names in ((seasonal.seasonal_variance(changes, ids), "season", list(calendar.seasons)), (seasonal.interannual_variance(changes, ids), "year", years[1:])):
        if names:
            v = table.groupBy(*ids).pivot(key, names).agg(F.first("var"))
            wide = wide.join(v.select(*ids, *[F.col(str(n)).alias(f"{n}_var") for n in names]), ids, "left")
    cells = lattice.cells(points.sparkSession).select("hex_id", "centroid_x", "centroid_y")
    return Covariates(lattice, series, means, changes, stored(cells.join(wide, "hex_id")))


def screen(c: Covariates, attributes: list[str], method: str = "getis_ord", weights: str = "distance_band", k: int = 8, permutations: int = 999, seed: int = 0) -> DataFrame:
    """The covariate table with each attribute's statistic, pseudo p and class; one edge table serves all."""
    if missing := [a for a in attributes if a not in c.columns]:
        raise KeyError(f"missing columns {missing}")
    pts = c.table.select(F.col("hex_id").alias("id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    if weights == "distance_band":
        edges = spatial.distance_band(pts)
    elif weights == "knn":
        edges = spatial.knn_weights(pts, k)
    elif weights == "queen":
        cells = c.lattice.cells(pts.sparkSession).join(c.table.select("hex_id"), "hex_id", "left_semi")
        edges = c.lattice.neighbours(cells).withColumn("w", F.lit(1.0))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    h = spatial.hotspots(c.table.withColumnRenamed("hex_id", "id"), attributes, edges, method, permutations, seed)
    return c.table.join(h.withColumnRenamed("id", "hex_id").drop(*attributes), "hex_id", "left")


def export(c: Covariates, screened: DataFrame, folder: str, name: str = "hotspots") -> dict[str, str]:
    """A styled bundle of cell centres, and the covariates and their missing shares as CSV folders."""
    from ..sources.qgis import QgisBundle

    b, out = QgisBundle(os.path.join(folder, "qgis"), name), {"qgis": os.path.join(folder, "qgis")}
    pts = screened.withColumnsRenamed({"centroid_x": "x", "centroid_y": "y"})
    b.add_points(pts, "covariates", graduated="total_mean")
    for col in [x for x in screened.columns if x.endswith("_class")]:
        b.add_points(pts, col, categorized=col)
    b.write()
    for key, df in (("covariates", c.table), ("missing", c.missing())):
        out[key] = os.path.join(folder, f"{key}.csv")
        df.write.mode("overwrite").csv(f"file://{os.path.abspath(out[key])}", header=True)
    return out
