"""Points to cells and per-cell aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import HexLattice


def aggregate_expr(name: str, col: str, order: str | None = None) -> Column:
    """A named statistic with nulls and NaN skipped; std and var are of samples, the sum of nothing is 0."""
    c = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")) if name not in ("nunique", "first", "last", "size") else F.col(col)
    key = F.col(order) if order else F.lit(0)
    table = {
        "mean": lambda: F.avg(c), "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)), "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(c),
        "size": lambda: F.count("*"), "std": lambda: F.stddev_samp(c), "var": lambda: F.var_samp(c), "median": lambda: F.median(c),
        "nunique": lambda: F.count_distinct(c), "first": lambda: F.min_by(c, F.when(c.isNotNull(), key)), "last": lambda: F.max_by(c, F.when(c.isNotNull(), key)),
    }
    if name not in table:
        raise ValueError(f"unknown aggregate {name!r}")
    return table[name]()


def points_to_cells(points: DataFrame, lattice: HexLattice, agg="mean", value_columns=None, x: str = "x", y: str = "y", count_column: str = "n_points", keep_empty: bool = True, order: str | None = None) -> DataFrame:
    """Cells with statistics of their points. agg: a name, a list of names, or {column: name or list}.

    A column's output is named ``<column>_<statistic>``, or just the column if all share one statistic. One aggregation; cells
    join afterwards, so the shuffle carries one partial row a cell and task.
    """
    skip = {x, y, "hex_id", "row", "col", "centroid_x", "centroid_y", "lon", "lat"}
    if isinstance(agg, dict):
        spec = {c: [a] if isinstance(a, str) else list(a) for c, a in agg.items()}
    else:
        names = [agg] if isinstance(agg, str) else list(agg)
        cols = value_columns or [c for c, k in points.dtypes if k in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in skip]
        spec = {c: names for c in cols}
    plain = len({tuple(a) for a in spec.values()}) == 1 and all(len(a) == 1 for a in spec.values())
    exprs = [aggregate_expr(a, c, order).alias(c if plain else f"{c}_{a}") for c, names in spec.items() for a in names]
    # -1 for points outside: a test for null would be pushed down and repeat the whole placement
    placed = lattice.place(points, x, y).withColumn("hex_id", F.coalesce("hex_id", F.lit(-1).cast("long")))
    stats = placed.groupBy("hex_id").agg(F.count("*").alias(count_column), *exprs)
    out = lattice.cells(points.sparkSession).join(stats, "hex_id", "left" if keep_empty else "inner")
    return out.withColumn(count_column, F.coalesce(count_column, F.lit(0).cast("long")))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a polygon ring (even-odd rule)."""
    hits = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            hits = hits + F.when(((y < ay) != (y < by)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return hits % 2 == 1


def assign_polygons(points: DataFrame, polygons: DataFrame, cell: float, id_col: str = "zone_id", ring: str = "ring", key: str = "pos_id") -> DataFrame:
    """points with the id of the polygon that holds them (the smallest id of several), null for none.

    polygons: id and ring (array of x, y structs). Both sides are dealt to square buckets of side ``cell``; the equi-join meets
    only polygons whose box covers the point's bucket, and a ray-casting expression decides.
    """
    box = polygons.select(F.col(id_col).alias("z_id"), F.col(ring).alias("z_ring"))
    box = box.withColumns({k: F.expr(f"array_{m}(transform(z_ring, p -> p.{a}))") for k, m, a in (("x0", "min", "x"), ("x1", "max", "x"), ("y0", "min", "y"), ("y1", "max", "y"))})
    box = box.withColumn("bx", F.explode(F.expr(f"sequence(floor(x0 / {cell}), floor(x1 / {cell}))"))).withColumn("by", F.explode(F.expr(f"sequence(floor(y0 / {cell}), floor(y1 / {cell}))")))
    p = points.select(F.col(key).alias("p_key"), "x", "y").withColumn("pbx", F.floor(F.col("x") / cell)).withColumn("pby", F.floor(F.col("y") / cell))
    odd = """aggregate(sequence(0, size(z_ring) - 2), 0, (n, k) -> n + if((y < z_ring[k].y) != (y < z_ring[k + 1].y)
        and x < (z_ring[k + 1].x - z_ring[k].x) * (y - z_ring[k].y) / nullif(z_ring[k + 1].y - z_ring[k].y, 0) + z_ring[k].x, 1, 0)) % 2 = 1"""
    hit = p.join(box, (F.col("pbx") == F.col("bx")) & (F.col("pby") == F.col("by"))).where("x between x0 and x1 and y between y0 and y1").where(odd)
    best = hit.groupBy("p_key").agg(F.min("z_id").alias(id_col))
    return points.join(best, F.col(key) == F.col("p_key"), "left").drop("p_key")
