"""The workflows end to end on small inputs with known answers, their exports and the command line."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattis import cli
from lattis.operators import raster
from lattis.plans import covariates, voyage, watershed
from lattis.sources import geo, qgis


def valley(spark, rows=20, cols=24):
    """A valley that falls to the south along its middle column."""
    r, c = np.mgrid[:rows, :cols]
    z = 200.0 - 2 * r + 3 * np.abs(c - cols // 2)
    return raster.raster_from_array(spark, z, (0, 0, 30 * cols, 30 * rows), 32615), z


def test_watershed(spark, tmp_path):
    dem, z = valley(spark)
    w = watershed.run_watershed([dem], (12.4 * 30, 15.0), stream_cells=20, min_cells=3)
    assert w.outlet == (19, 12)
    n = w.stats["catchment_cells"]
    assert n == w.stats["outlet_accumulation_cells"] == w.inside.where("inside = 1").count() > 200
    assert w.stats["catchment_area_km2"] == pytest.approx(n * 900 / 1e6)
    assert (w.stats["min_elevation"], w.stats["max_elevation"]) == (z.min(), z.max())
    for x in w.lines.collect():
        assert x.elevation_min <= x.elevation_mean <= x.elevation_max and x.slope_m_per_km > 0 and x.path[-1].x == 12.5 * 30
    rings = watershed.outline(w)
    area = abs(sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:], strict=False)) / 2 for g in rings))
    assert area == pytest.approx(n * 900)
    watershed.export(w, str(tmp_path))
    layers = json.loads((tmp_path / "qgis" / "manifest.json").read_text())["layers"]
    assert {x["name"] for x in layers} == {"dem", "flow_accumulation_log", "catchment_mask", "outlet", "flowlines"}
    assert all((tmp_path / "qgis" / x[k]).exists() for x in layers for k in ("path", "style"))
    assert geo.read_raster(spark, str(tmp_path / "qgis" / "catchment_mask.tif")).valid().agg(F.sum("value")).first()[0] == n


def test_tiles_equal_the_whole(spark):
    dem, _ = valley(spark)
    g = dem.grid
    west = raster.Raster(dem.cells.where("col < 10"), raster.GridSpec.from_bounds(20, 10, (0, 0, 300, 600), 32615))
    east = raster.Raster(dem.cells.where("col >= 10").withColumn("col", F.col("col") - 10), raster.GridSpec.from_bounds(20, 14, (300, 0, 720, 600), 32615))
    both = watershed.load_dem([west, east])
    assert both.grid.bounds == g.bounds and both.cells.exceptAll(dem.cells.select(*both.cells.columns)).count() == 0
    with pytest.raises(ValueError):
        watershed.load_dem([])


def observations(spark):
    """Two years, two seasons, a lattice of 100 m; the east is warm."""
    rows = [(100.0 * i, 100.0 * j, y, d, (10.0 if i >= 12 else 1.0) * (2 if y == 2018 else 1)) for i in range(16) for j in range(16) for y in (2017, 2018) for d in (15, 200)]
    return spark.createDataFrame(rows, "x double, y double, year int, doy int, value double")


def test_covariates(spark, tmp_path):
    obs = observations(spark)
    assert covariates.spacing(obs) == 100.0
    assert covariates.spacing(obs.where("x = 0")) is None
    c = covariates.build_covariates(obs)
    assert c.lattice.radius == 300 and set(c.columns) == {"winter_mean", "summer_mean", "total_mean", "winter_var", "summer_var", "2018_var"}
    west = c.table.where("centroid_x < 800").first()
    assert west.total_mean == pytest.approx(1.5) and west["2018_var"] == 0 and west.winter_var is None
    s = covariates.screen(c, ["total_mean"], weights="queen", permutations=99)
    hot = [r.centroid_x for r in s.where("total_mean_gi_z > 1.96").collect()]
    assert hot and min(hot) > 800
    with pytest.raises(ValueError):
        covariates.screen(c, ["total_mean"], weights="none")
    with pytest.raises(KeyError):
        covariates.screen(c, ["nothing"])
    paths = covariates.export(c, s, str(tmp_path))
    assert all(os.path.exists(p) for p in paths.values())


def telemetry(spark, n=400):
    d = spark.range(n).select(
        (F.lit(1706745600) + F.col("id") * 600).alias("timestamp"), (F.lit(10.0) + F.col("id") / 100).alias("longitude"), (F.lit(50.0) + F.col("id") / 200).alias("latitude"),
        (F.col("id") % 17 + F.col("id") / 1000).cast("double").alias("speed"), (F.col("id") % 23 * 0.5 + F.col("id") / 3000).alias("wind"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("port"),
    )
    return d.withColumn("fuel", 5 + 3 * F.col("speed") - F.col("wind") + F.when(F.col("port") == "b", 2.0).otherwise(0.0))


def test_voyage(spark, tmp_path):
    d = telemetry(spark)
    design = voyage.prepare_design(d, "fuel")
    assert design.dummies["port"] == ["port_b", "port_c"] and {"speed", "wind", "is_night"} <= set(design.features) and not {"longitude", "timestamp"} & set(design.features)
    v = voyage.run_voyage(d, "fuel", models=("linear", "lasso"), cv=2, n_iter=1, repeats=1)
    assert v.best_model == "linear" and v.stats["holdout_r2"] > 0.999 and v.stats["ols_r2_adj"] > 0.999
    assert v.residuals.count() == 80 and v.residuals.agg(F.min("timestamp")).first()[0] == 1706745600 + 320 * 600
    assert v.importances.first().column == "speed"
    assert all(os.path.exists(p) for p in voyage.export(v, str(tmp_path)).values())
    track = voyage.voyage_track(d, values=("speed",)).collect()
    assert [r.timestamp for r in track] == sorted(r.timestamp for r in track)


def test_styles_escape_and_count(spark, tmp_path):
    import xml.etree.ElementTree as ET

    doc = ET.fromstring(qgis.categorized_style("a<b", ["x & y", "z"]))
    assert [c.get("value") for c in doc.iter("category")] == ["x & y", "z"]
    assert len(list(ET.fromstring(qgis.graduated_style("v", [1.0, 2.0, 3.0], 0.0)).iter("range"))) == 3
    pts = spark.createDataFrame([(0.0, 0.0, 1.0)], "x double, y double, v double")
    b = qgis.QgisBundle(str(tmp_path)).add_points(pts.limit(0), "none").add_points(pts, "one", graduated="v")
    assert [x["name"] for x in b.write()["layers"]] == ["one"]
    with pytest.raises(KeyError):
        b.add_points(pts, "bad", graduated="w")


def test_command_line(spark, tmp_path):
    _, z = valley(spark)
    (tmp_path / "a.tif").write_bytes(geo.encode_tiff(z, raster.GridSpec.from_bounds(20, 24, (0, 0, 720, 600), 32615)))
    stats = cli.main(["hydrology", str(tmp_path / "a.tif"), "--x", "372", "--y", "15", "--out", str(tmp_path / "out")])
    assert json.loads((tmp_path / "out" / "summary.json").read_text()) == stats and stats["catchment_cells"] > 200
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])
