"""Queries: rasters, terrain, lines, weights, local statistics, regression and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, raster, regression, spatial, terrain
from ..operators.cells import points_to_cells
from ..runtime import stored
from ..sources import carriers
from ..sources.carriers import COLS, LINES, POSITIONS, RASTER, VECTORS, ZONES, table
from .relational import _HEX_SMALL, _W, lattice, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


@query(f'WITH {RASTER} SELECT r AS "row", c AS col, c + 0.5 AS x, -(r + 0.5) AS y, round(z, 4) AS value FROM ras'.replace("c + 0.5", "CAST(c + 0.5 AS DOUBLE)").replace("-(r + 0.5)", "CAST(-(r + 0.5) AS DOUBLE)"))
def raster_cells(spark, sf):
    return raster.to_points(carriers.raster(spark, sf)).select("row", "col", "x", "y", F.round("value", 4).alias("value"))


@query(f"WITH {POSITIONS}, {RASTER} SELECT pos_id, round(z, 4) AS value FROM pos LEFT JOIN ras ON floor(x / 400) = c AND floor(y / 400) = r")
def raster_sample(spark, sf):
    p = carriers.positions(spark, sf).select("pos_id", (F.col("x") / 400).alias("x"), (-F.col("y") / 400 - 1e-9).alias("y"))
    p = p.withColumn("y", -F.floor(-F.col("y")) - 0.5)
    return raster.sample_points(carriers.raster(spark, sf), p).select("pos_id", F.round("value", 4).alias("value"))


def _tiles(spark, sf):
    r = carriers.raster(spark, sf)
    left = raster.Raster(r.cells.where("col < 30"), r.grid)
    right = raster.Raster(r.cells.where("col >= 20").select("row", (F.col("col") - 20).alias("col"), (F.col("value") + 1000).alias("value")), raster.GridSpec(r.grid.rows, COLS - 20, c=20.0))
    return [left, right]


@query(f'WITH {RASTER} SELECT r AS "row", c AS col, round(CASE WHEN c < 30 THEN z ELSE z + 1000 END, 4) AS value FROM ras')
def mosaic_first(spark, sf):
    return raster.merge(_tiles(spark, sf)).cells.select("row", "col", F.round("value", 4).alias("value"))


_RING = [(5.2, -1.1), (30.4, -2.3), (22.7, -30.6), (8.9, -20.2)]


def _ring_sql(x: str, y: str) -> str:
    parts = [f"(CASE WHEN ({y} < {ay}) <> ({y} < {by}) AND {x} < ({bx - ax!r}) * ({y} - ({ay})) / ({by - ay!r}) + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx, by) in zip(_RING, _RING[1:] + _RING[:1], strict=True)]
    return f"({' + '.join(parts)}) % 2 = 1"


@query(f'WITH {RASTER} SELECT r - 1 AS "row", c - 5 AS col, round(z, 4) AS value FROM ras WHERE {_ring_sql("(c + 0.5::DOUBLE)", "(-(r + 0.5::DOUBLE))")}')
def clip_raster(spark, sf):
    return raster.clip(carriers.raster(spark, sf), _RING).cells.select("row", "col", F.round("value", 4).alias("value"))


_NB = "nb AS (SELECT * FROM (VALUES (0, 1, 1, 0), (1, 1, 2, 1), (1, 0, 4, 2), (1, -1, 8, 3), (0, -1, 16, 4), (-1, -1, 32, 5), (-1, 0, 64, 6), (-1, 1, 128, 7)) t(dr, dc, code, k))"
_D8 = f"""{RASTER}, {_NB}, dro AS (SELECT a.r, a.c, code, k, (a.z - b.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2) ELSE 1 END AS d, dr, dc FROM ras a CROSS JOIN nb JOIN ras b ON b.r = a.r + dr AND b.c = a.c + dc),
  bst AS (SELECT r, c, arg_min(struct_pack(code := code, dr := dr, dc := dc), (-d, k)) AS b FROM dro WHERE d > 0 GROUP BY r, c),
  dir AS (SELECT ras.r, ras.c, coalesce(b.code, 0) AS code, (ras.r + b.dr) * {COLS} + ras.c + b.dc AS recv, ras.r * {COLS} + ras.c AS cell FROM ras LEFT JOIN bst USING (r, c))"""
_D8R = "WITH RECURSIVE " + _D8
_WALK = f"{_D8R}, wlk AS (SELECT cell AS start, cell, recv FROM dir UNION ALL SELECT start, d.cell, d.recv FROM wlk JOIN dir d ON d.cell = wlk.recv), acc AS (SELECT cell, CAST(count(*) AS DOUBLE) AS acc FROM wlk GROUP BY cell)"
_OUT = f"{_WALK}, snp AS (SELECT cell FROM acc WHERE cell // {COLS} BETWEEN 0 AND 7 AND cell % {COLS} BETWEEN 20 AND 30 ORDER BY acc DESC, cell LIMIT 1)"


@query(f'WITH {_D8} SELECT r AS "row", c AS col, CAST(code AS INT) AS direction FROM dir')
def d8(spark, sf):
    return terrain.d8_flow_direction(carriers.raster(spark, sf))


def _recv(spark, sf):
    return terrain.receivers(terrain.d8_flow_direction(carriers.raster(spark, sf)), COLS)


@query(f"{_WALK} SELECT cell, acc FROM acc")
def flow_accumulation(spark, sf):
    return terrain.flow_accumulation(stored(_recv(spark, sf)))


@query(f"{_WALK} SELECT cell, CAST(acc >= 12 AS INT) AS stream FROM acc")
def stream_mask(spark, sf):
    return terrain.flow_accumulation(stored(_recv(spark, sf))).select("cell", (F.col("acc") >= 12).cast("int").alias("stream"))


def _snapped(spark, sf):
    recv, grid = stored(_recv(spark, sf)), carriers.raster(spark, sf).grid
    acc = terrain.flow_accumulation(recv)
    r, c = terrain.snap_pour_point(acc, 2, 25, grid.rows, grid.cols, 5)
    return recv, r * COLS + c


@query(f'{_OUT} SELECT cell // {COLS} AS "row", cell % {COLS} AS col FROM snp')
def snap_pour_point(spark, sf):
    _, cell = _snapped(spark, sf)
    return spark.createDataFrame([(cell // COLS, cell % COLS)], "row long, col long")


@query(f"{_OUT} SELECT d.cell, CAST(d.cell IN (SELECT start FROM wlk WHERE cell = (SELECT cell FROM snp)) AS INT) AS inside FROM dir d")
def catchment(spark, sf):
    return terrain.catchment(*_snapped(spark, sf))


@query(f"{_D8R}, wlk AS (SELECT cell AS start, CAST(0 AS BIGINT) AS step, cell, recv FROM dir UNION ALL SELECT start, step + 1, d.cell, d.recv FROM wlk JOIN dir d ON d.cell = wlk.recv) SELECT start, step, cell FROM wlk")
def downstream_path(spark, sf):
    recv = stored(_recv(spark, sf))
    return terrain.downstream_paths(recv, recv.select(F.col("cell").alias("start")))


@query()
def fill_depressions(spark, sf):
    return terrain.fill_depressions(carriers.raster(spark, sf), 1e-3).select("row", "col", F.round("value", 6).alias("value"))


@query(f"""WITH {RASTER}, {ZONES}, hit AS (SELECT r, c, z, max(zone_id) AS zone_id FROM ras JOIN zon ON c + 0.5 BETWEEN x0 AND x1 AND -(r + 0.5) BETWEEN y0 AND y1 GROUP BY r, c, z),
  s AS (SELECT zone_id, avg(z) AS mean, min(z) AS min, max(z) AS max, stddev_samp(z) AS std, median(z) AS median, count(*) AS count FROM hit GROUP BY zone_id)
  SELECT zon.zone_id, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std, round(median, 6) AS median, coalesce(count, 0) AS count FROM zon LEFT JOIN s USING (zone_id)""")
def zonal_stats(spark, sf):
    s = raster.zonal_statistics(carriers.zones(spark, sf), carriers.raster(spark, sf), ("mean", "min", "max", "std", "median", "count"))
    return s.select("zone_id", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "std", "median")], "count")


_SEG = f"{LINES}, seg AS (SELECT line_id, k, x, y, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM lin WINDOW w AS (PARTITION BY line_id ORDER BY k)), dl AS (SELECT *, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS len FROM seg)"


@query(f"""WITH {_SEG}, n AS (SELECT *, CASE WHEN qx IS NULL THEN 1 ELSE greatest(1, CAST(ceil(len / 1.5) AS BIGINT)) END AS n FROM dl), v AS (SELECT line_id, k, n, x, y, qx, qy, unnest(range(n)) AS j FROM n)
  SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY k, j) - 1 AS vertex_index, round(x + coalesce(j / n * (qx - x), 0), 6) AS x, round(y + coalesce(j / n * (qy - y), 0), 6) AS y FROM v""")
def line_vertices(spark, sf):
    v = raster.line_vertices(carriers.lines(spark, sf), densify_every=1.5)
    return v.select("line_id", F.col("vertex_index").cast("long").alias("vertex_index"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {RASTER}, {_SEG}, c AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY k) AS hi FROM dl WHERE len IS NOT NULL), t AS (SELECT *, hi - len AS lo, max(k) OVER (PARTITION BY line_id) AS lk FROM c),
  m AS (SELECT *, unnest(range(CAST(ceil(lo / 2.3) AS BIGINT), CAST(floor(hi / 2.3) AS BIGINT) + 1)) * 2.3::DOUBLE AS distance FROM t), p AS (SELECT line_id, distance, x + (distance - lo) / len * (qx - x) AS px, y + (distance - lo) / len * (qy - y) AS py FROM m WHERE distance < hi OR k = lk)
  SELECT line_id, round(distance, 6) AS distance, round(z, 6) AS value FROM p LEFT JOIN ras ON floor(px) = c AND floor(-py) = r""")
def line_profile(spark, sf):
    p = raster.line_profile(carriers.raster(spark, sf), carriers.lines(spark, sf), 2.3)
    return p.select("line_id", F.round("distance", 6).alias("distance"), F.round("value", 6).alias("value"))


@query(f"""WITH {RASTER}, {LINES}, v AS (SELECT line_id, z FROM lin LEFT JOIN ras ON floor(x) = c AND floor(-y) = r) SELECT line_id, round(avg(z), 6) AS z_mean, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM v GROUP BY line_id""")
def line_samples(spark, sf):
    s = raster.sample_lines(carriers.raster(spark, sf), carriers.lines(spark, sf), name="z")
    return s.select("line_id", *[F.round(f"z_{k}", 6).alias(f"z_{k}") for k in ("mean", "min", "max")])


_NEAR = f"{VECTORS}, nea AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM vec a JOIN vec b ON a.id <> b.id)"


@query(f"WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM nea) SELECT i, j, round(d, 6) AS d, CAST(r AS INT) AS rank FROM k WHERE r <= 4")
def knn_weights(spark, sf):
    return spatial.knn(carriers.vectors(spark, sf), 4).select("i", "j", F.round("d", 6).alias("d"), "rank")


@query(f"WITH {_NEAR}, k AS (SELECT i, j, pow(d, -1.5) AS w FROM nea WHERE d <= 0.1) SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM k")
def distance_band_weights(spark, sf):
    return spatial.distance_band(carriers.vectors(spark, sf), 0.1).select("i", "j", rounded("w", 6))


_QUEEN = f"{POSITIONS}, {_HEX_SMALL}, que AS (SELECT a.hex_id AS i, b.hex_id AS j FROM cells a JOIN cells b ON a.hex_id <> b.hex_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < {(1.05 * _W) ** 2!r}), val AS (SELECT cells.hex_id AS id, CAST(count(pos_id) AS DOUBLE) AS x FROM cells LEFT JOIN near USING (hex_id) GROUP BY cells.hex_id)"


@query(f"WITH {_QUEEN} SELECT i, j FROM que")
def queen_weights(spark, sf):
    lat = lattice(spark, sf)
    return lat.neighbours(lat.cells(spark))


def _values(spark, sf):
    lat = lattice(spark, sf)
    c = points_to_cells(carriers.positions(spark, sf), lat, "mean", ["alt"])
    return c.select(F.col("hex_id").alias("id"), F.col("n_points").cast("double").alias("x")), lat.neighbours(lat.cells(spark)).withColumn("w", F.lit(1.0))


@query(f"""WITH {_QUEEN}, t AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM val), e AS (SELECT i, j FROM que UNION ALL SELECT id, id FROM val), g AS (SELECT i, sum(x) AS wx, count(*) AS w FROM e JOIN val ON j = id GROUP BY i)
  SELECT i AS id, round((wx - m * w) / (s * sqrt((n * w - w * w) / (n - 1))), 6) AS gi_z FROM g, t""")
def gi_star_z(spark, sf):
    return spatial.getis_ord(*_values(spark, sf)).withColumn("gi_z", F.round("gi_z", 6))


@query()
def gi_star_p(spark, sf):
    return spatial.permutation_p(*_values(spark, sf), permutations=99)


@query(f"""WITH {_QUEEN}, t AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM val), z AS (SELECT id, n, (x - m) / s AS z FROM val, t), l AS (SELECT i, avg(z) AS lag FROM que JOIN z ON j = id GROUP BY i)
  SELECT id, round((n - 1) / n * z * lag, 6) AS lisa_i, CAST(CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS INT) AS quadrant FROM z JOIN l ON i = id""")
def local_moran_i(spark, sf):
    return spatial.local_moran(*_values(spark, sf)).select("id", F.round("lisa_i", 6).alias("lisa_i"), "quadrant")


@query()
def lisa_class(spark, sf):
    return spatial.lisa_clusters(*_values(spark, sf), permutations=99).select("id", "lisa_class")


def _items(spark, sf):
    return table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
def ols_coefficients(spark, sf):
    r = regression.fit_ols(_items(spark, sf), "l_extendedprice", ["l_quantity"], robust=None)
    return spark.createDataFrame([(c["term"], round(c["estimate"], 4)) for c in r.coefficients()], "term string, estimate double")


@query()
def ols_robust(spark, sf):
    return regression.fit_ols(_items(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).frame(spark)


@query()
def elastic_net(spark, sf):
    return regression.fit_regularized_ols(_items(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).frame(spark)


@query("""WITH p AS (SELECT l_extendedprice AS o, 1500.0::DOUBLE * l_quantity AS p FROM lineitem) SELECT round(sqrt(avg((p - o) * (p - o))), 4) AS rmse, round(avg(abs(p - o)), 4) AS mae, round(1 - sum((p - o) * (p - o)) / (var_pop(o) * count(o)), 6) AS r2,
  round(avg(abs((p - o) / nullif(o, 0))), 6) AS mape, round(avg(p - o), 4) AS bias, count(*) AS n FROM p""")
def regression_metrics(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("observed"), F.expr("1500D * l_quantity").alias("predicted"))
    m = learning.regression_metrics(d)
    return m.select(*[F.round(c, 4 if c in ("rmse", "mae", "bias") else 6).alias(c) for c in ("rmse", "mae", "r2", "mape", "bias")], "n")


@query("SELECT o_orderkey, o_totalprice AS observed, 1000.0::DOUBLE * (o_custkey % 100) AS predicted, round(o_totalprice - 1000.0::DOUBLE * (o_custkey % 100), 4) AS residual FROM orders")
def residuals(spark, sf):
    o = table(spark, sf, "orders").withColumn("prediction", F.expr("1000D * (o_custkey % 100)"))
    return learning.residual_frame(o, "o_totalprice", keep=["o_orderkey"]).withColumn("residual", F.round("residual", 4))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query()
def cv_leaderboard(spark, sf):
    return learning.compare_models(_items(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"], ("linear", "ridge", "lasso", "elastic_net"), _KEYS, cv=5).drop("fit_time_s")


@query()
def cv_trees(spark, sf):
    small = {"random_forest": {"trees": 5, "depth": 4}, "gradient_boosting": {"iters": 5}}
    return learning.compare_models(_items(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"], tuple(small), _KEYS, cv=2, params=small).drop("fit_time_s")


@query()
def tuned_model(spark, sf):
    return learning.tune_model(_items(spark, sf), "elastic_net", "l_extendedprice", ["l_quantity", "l_discount"], n_iter=2, cv=2, keys=_KEYS)[1]


@query()
def permutation_importance(spark, sf):
    d = _items(spark, sf)
    m = learning.build_pipeline("linear", ["l_quantity", "l_discount", "l_tax"], target="l_extendedprice").fit(d)
    return learning.permutation_importances(m, d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], n_repeats=2)
