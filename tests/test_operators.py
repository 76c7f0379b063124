"""Identities, planted signals and brute force for single operators."""

import heapq
import math
import os

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from lattis.functions import crs, special
from lattis.functions.hexgrid import HexLattice, hex_area_from_radius, hex_radius_from_area, hex_radius_from_travel_time
from lattis.functions.temporal import filter_by_hour
from lattis.operators import encoding, inference, learning, proximity, raster, regression, seasonal, spatial, terrain
from lattis.operators.cells import assign_polygons, points_to_cells
from lattis.plans import registry
from lattis.sources import carriers, geo, tabular


def test_special_functions():
    assert special.poisson_sf(20, 4.8) == pytest.approx(1 - sum(math.exp(-4.8) * 4.8**i / math.factorial(i) for i in range(20)), abs=1e-12)
    assert special.poisson_sf(3, 1.0) == pytest.approx(1 - 2.5 / math.e)
    assert list(special.poisson_sf([0, 2], [0, 0])) == [1, 0]
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("code", [32615, 32733, 3857, 6933, "conus-albers"])
def test_projections_round_trip(spark, code):
    lon, lat = (-95.5, 38.25) if code != 32733 else (16.2, -33.1)
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    x, y = crs.forward(F.col("lon"), F.col("lat"), code)
    p = df.withColumns({"x": x, "y": y})
    a, b = crs.inverse(F.col("x"), F.col("y"), code)
    r = p.select("x", "y", a.alias("a"), b.alias("b")).first()
    assert r.a == pytest.approx(lon, abs=1e-6) and r.b == pytest.approx(lat, abs=1e-6)
    assert crs.utm_epsg_for(-93.0, 40) == 32615
    if code == 32615:
        m = df.select(crs.forward(F.lit(-93.0), F.lit(0.0), code)[0].alias("x")).first()
        assert m.x == pytest.approx(500000)


def test_hexagons(spark):
    assert hex_radius_from_area(hex_area_from_radius(77.0)) == pytest.approx(77)
    assert hex_radius_from_travel_time(60, 5) == pytest.approx(60 * 0.514444 * 300 / 2)
    with pytest.raises(ValueError):
        hex_radius_from_area(0)
    rng = np.random.default_rng(1)
    pts = rng.uniform(0, 5000, (400, 2))
    lat = HexLattice.over((0, 0, 5000, 5000), 400.0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    cells = {r.hex_id: (r.centroid_x, r.centroid_y) for r in lat.cells(spark).collect()}
    for r in lat.place(df).collect():
        near = min(cells, key=lambda k: (cells[k][0] - r.x) ** 2 + (cells[k][1] - r.y) ** 2)
        assert r.hex_id == near
    total = points_to_cells(df.withColumn("v", F.lit(2.0)), lat, "sum", ["v"]).agg(F.sum("n_points"), F.sum("v")).first()
    assert tuple(total) == (400, 800.0)


def test_proximity_is_brute_force_and_ignores_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 17 == 0 else i % 9, float(rng.uniform(0, 300)), float(rng.uniform(0, 900)), float(rng.uniform(0, 900)), None if i % 23 == 0 else float(rng.uniform(0, 300))) for i in range(300)]
    df = spark.createDataFrame(rows, "pos_id long, track long, t double, x double, y double, alt double")
    c = proximity.ProximityConfig(200, 100, 20)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[5] is not None and b[5] is not None and abs(a[2] - b[2]) <= 20 and abs(a[5] - b[5]) <= 100 and math.hypot(a[3] - b[3], a[4] - b[4]) <= 200}
    for cells in ("time", "space_time", "auto"):
        assert {(r.i, r.j) for r in proximity.proximity_pairs(df, c, cells).collect()} == want
    assert proximity.proximity_counts(df, c).agg(F.sum("event_count")).first()[0] == 2 * len(want)


def _moved(df) -> int:
    """Rows that the plan's exchanges write or broadcast; the session must not plan adaptively."""
    q, rows = df._jdf.queryExecution(), 0
    q.toRdd().count()
    nodes = [q.executedPlan()]
    while nodes:
        n = nodes.pop()
        for k in ("shuffleRecordsWritten", *["numOutputRows"] * n.nodeName().startswith("BroadcastExchange")):
            rows += n.metrics().apply(k).value() if n.metrics().contains(k) else 0
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    return rows


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_distance_band_is_brute_force_and_shuffles_no_edges(spark, fixed_plans):
    rng = np.random.default_rng(5)
    # a dense cluster, and a line of points whose distances are the bound itself
    rows = [(i, *map(float, rng.uniform(-0.3, 0.3, 2))) for i in range(400)] + [(1000 + i, 10.0 + i, -7.0) for i in range(5)] + [(2000, None, 0.0), (2001, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    near = {(a[0], b[0]): math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) for a in rows for b in rows if a[0] != b[0] and None not in a + b}
    near = {k: d**-1.5 for k, d in near.items() if d <= 1}
    total = {}
    for (i, _), w in near.items():
        total[i] = total.get(i, 0) + w
    out = spatial.distance_band(df, 1.0)
    got = {(r.i, r.j): r.w for r in out.collect()}
    assert got.keys() == near.keys() and (1000, 1001) in got and len(got) > 150_000
    assert all(got[k] == pytest.approx(w / total[k[0]]) for k, w in near.items())
    assert _moved(spatial.distance_band(df, 1.0)) < len(got) / 2
    plain = {(r.i, r.j): r.w for r in spatial.distance_band(df, 1.0, standardise=False).collect()}
    assert plain.keys() == near.keys() and all(plain[k] == pytest.approx(w) for k, w in near.items())


def _reports(spark):
    """Reports in whole steps of the bounds (10 s, 100 m, 5 up), so that many pairs lie on a bound, with ties in time, missing and odd values."""
    rng = np.random.default_rng(6)
    rows = [(f"p{i:04}", None if i % 13 == 0 else f"k{i % 7}", float(5 * rng.integers(-40, 40)), float(50 * rng.integers(-6, 6)), float(50 * rng.integers(-6, 6)), float(2.5 * rng.integers(0, 9))) for i in range(1200)]
    odd = [("q0", "z", None, 0.0, 0.0, 5.0), ("q1", "z", 0.0, float("nan"), 0.0, 5.0), ("q2", "z", 0.0, 0.0, float("inf"), 5.0), ("q3", "z", 0.0, 0.0, 0.0, None), (None, "z", 0.0, 0.0, 0.0, 5.0), ("p0005", "z", 0.0, 0.0, 0.0, 5.0)]
    every = [r for r in rows + odd[-1:]]
    want = {}
    for a in every:
        for b in every:
            d = math.hypot(a[3] - b[3], a[4] - b[4])
            if a[0] < b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 10 and d <= 100 and abs(a[5] - b[5]) <= 5:
                want.setdefault((a[0], b[0]), []).append((d, abs(a[2] - b[2]), min(a[2], b[2])))
    return spark.createDataFrame(rows + odd, "pos_id string, track string, t double, x double, y double, alt double").repartition(5), want


@pytest.mark.parametrize("dense", [1, 20, 200, 10_000])
def test_proximity_over_groups_and_tiles(spark, dense):
    df, want = _reports(spark)
    c = proximity.ProximityConfig(100, 5, 10, dense)
    got = {}
    for r in proximity.proximity_pairs(df, c).collect():
        got.setdefault((r.i, r.j), []).append((round(r.distance_m, 6), r.dt_s))
    assert got.keys() == want.keys() and len(want) > 1000
    assert all(sorted(got[k]) == sorted((round(d, 6), dt) for d, dt, _ in want[k]) for k in want)
    assert proximity.proximity_pairs(df.limit(0), c).count() == 0


def test_proximity_moves_few_rows_of_a_dense_fleet(spark, fixed_plans):
    rng = np.random.default_rng(7)
    rows = [(i, i % 300, float(rng.uniform(0, 100)), float(rng.uniform(0, 9000)), float(rng.uniform(0, 9000)), 5.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "pos_id long, track long, t double, x double, y double, alt double")
    assert len(rows) <= _moved(proximity.proximity_pairs(df, proximity.ProximityConfig(300, 50, 10))) < 2 * len(rows)


@pytest.mark.parametrize("dense", [1, 200, 10_000])
def test_proximity_counts_without_pairs(spark, fixed_plans, dense):
    df, want = _reports(spark)
    c = proximity.ProximityConfig(100, 5, 10, dense)
    n = {}
    for ids, found in want.items():
        for k in ids:
            n[k] = n.get(k, 0) + len(found)
    counted = proximity.proximity_counts(df, c)
    got = [(r.pos_id, r.event_count) for r in counted.collect()]
    assert len(got) == df.count() and all(v == n.get(k, 0) for k, v in got if k)
    assert sorted(got, key=str) == sorted(((r.pos_id, r.event_count) for r in proximity.proximity_counts(df, c, proximity.proximity_pairs(df, c)).collect()), key=str)


def test_proximity_counts_move_no_pairs(spark, fixed_plans):
    df = spark.range(600).selectExpr("id pos_id", "id track", "id / 1000 t", "id / 10 x", "0D y", "5D alt")
    counted = proximity.proximity_counts(df, proximity.ProximityConfig(300, 50, 10))
    assert {r.event_count for r in counted.collect()} == {599}
    assert 600 <= _moved(counted) <= 4 * 600


@pytest.mark.parametrize("dense", [1, 200, 10_000])
def test_proximity_windows(spark, fixed_plans, dense):
    df, want = _reports(spark)
    c = proximity.ProximityConfig(100, 5, 10, dense)
    n = {}
    for found in want.values():
        for _, _, first in found:
            n[(first + 200) // 30] = n.get((first + 200) // 30, 0) + 1
    assert {r.window_id: r.pairs for r in proximity.window_counts(df, c, 30).collect()} == n
    pairs = proximity.windowed_pairs(df, c, 30)
    assert {r.window_id: r["count"] for r in pairs.groupBy("window_id").count().collect()} == n and set(pairs.columns) == {"i", "j", "distance_m", "dt_s", "window_id"}
    assert _moved(pairs) < df.count() * (2 if dense > 1000 else 8) + len(want)


@pytest.fixture(scope="session")
def fleet(spark, sf, tmp_path_factory):
    """The test tables with 3,000 events in five time buckets of the queries."""
    d = tmp_path_factory.mktemp("fleet")
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(f"{sf}/{f}", d / f)
    ts = "timestamp_ntz'2024-01-01 05:30:00' + make_interval(0, 0, 0, 0, 0, 0, id)"
    spark.range(3000).selectExpr("id event_id", f"{ts} ts", "id % 90 user_id", "'a' event_type", "id % 211 + 0.5D value", "'' props").coalesce(1).write.parquet(str(d / "some"))
    os.rename(next((d / "some").glob("part-*")), d / "events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["airspace_cells", "flag_unacceptable", "hourly_profile", "summarise_cells"])
def test_queries_of_counts_move_few_rows_of_a_dense_fleet(spark, fixed_plans, fleet, name):
    same(registry.QUERIES[name](spark, fleet), registry.ORACLES[name], fleet)
    assert _moved(registry.QUERIES[name](spark, fleet)) < 6 * 3000


def test_cells_find_pairs_once(spark, fleet, monkeypatch):
    """However often the class bounds read the cells: the cells are stored before."""
    from lattis.plans import airspace

    found = []
    monkeypatch.setattr(airspace.inference, "risk_levels", lambda c, *a: found.append(c) or c)
    pos = carriers.positions(spark, fleet)
    lattice = HexLattice.for_points(pos, radius=1500.0)
    airspace.summarise_cells(proximity.proximity_counts(pos, proximity.ProximityConfig(3000, 50, 600)), lattice)
    assert "MapInArrow" not in found[0]._jdf.queryExecution().executedPlan().toString() and "Join" not in found[0]._jdf.queryExecution().executedPlan().toString()
    assert found[0].agg(F.sum("n_points")).first()[0] == 3000


def test_exposure_of_reused_tracks(spark):
    rows = [("a", float(4 * i + day * 86400)) for day in (0, 1) for i in range(151)]
    df = spark.createDataFrame(rows, "track string, t double")
    assert proximity.exposure_hours(df).first()[0] == pytest.approx(20 / 60)
    assert proximity.exposure_hours(df, track=None).first()[0] > 24


def test_seasons(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 2.0, 2.0), (2, None, 1.0, 3.0, 0.0)], "id long, chlor_2017015 double, chlor_2017200 double, chlor_2018015 double, chlor_2018200 double")
    ys = seasonal.year_season_means(seasonal.long_from_wide(df, ["id"]), ["id"])
    yoy = {(r.id, r.year, r.season): r.change for r in seasonal.year_over_year(ys, ["id"]).collect()}
    assert yoy[1, 2018, "winter"] == 1.0 and yoy[1, 2018, "summer"] == 0.0 and yoy[2, 2018, "winter"] is None
    means = {(r.id, r.season): r["mean"] for r in seasonal.seasonal_means(ys, ["id"]).collect()}
    assert means[1, "winter"] == 1.5
    with pytest.raises(ValueError):
        seasonal.SeasonCalendar().season_for(400)


def test_filter_by_hour(spark):
    df = spark.range(24).select(F.expr("timestamp_ntz'2024-01-01 05:00:00' + make_interval(0, 0, 0, 0, int(id))").alias("ts"))
    assert sorted(r.hour for r in filter_by_hour(df, "ts").collect()) == list(range(7, 19))


def test_inference(spark):
    p = spark.createDataFrame([(x,) for x in (0.001, 0.01, 0.02, 0.5, 0.9)], "p_value double")
    got = {r.p_value: r for r in inference.benjamini_hochberg(p).collect()}
    assert [got[x].significant for x in (0.001, 0.01, 0.02, 0.5, 0.9)] == [True, True, True, False, False]
    assert all(r.p_adjusted >= r.p_value for r in got.values())
    v = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 0, 1, 2, 3, 40, 50)], "v double")
    r = {x.v: x for x in inference.risk_levels(v, "v").collect()}
    assert r[0.0].risk_level == 0 and r[50.0].risk_label == "high"
    for s in inference.SCHEMES:
        b = inference.class_bounds(v, "v", 3, s)
        assert b == sorted(b) and b[-1] == 50
    d = spark.range(4000).selectExpr("id % 24 as hour", "if((id % 24 < 12) = (id % 10 < 8), 'a', 'b') as label")
    t = inference.chi_square(d, "label", "hour")
    assert t.p_value < 1e-6 and t.residuals.count() == 48
    with pytest.raises(ValueError):
        inference.chi_square(d.where("label = 'a'"), "label", "hour")


def _flood(z, eps):
    n, m = z.shape
    w, heap, seen = z.copy(), [], np.zeros(z.shape, bool)
    for r in range(n):
        for c in range(m):
            if r in (0, n - 1) or c in (0, m - 1):
                heapq.heappush(heap, (z[r, c], r, c))
                seen[r, c] = True
    while heap:
        v, r, c = heapq.heappop(heap)
        for a in range(max(0, r - 1), min(n, r + 2)):
            for b in range(max(0, c - 1), min(m, c + 2)):
                if not seen[a, b]:
                    seen[a, b] = True
                    w[a, b] = z[a, b] if z[a, b] > v else v + eps
                    heapq.heappush(heap, (w[a, b], a, b))
    return w


def test_terrain(spark):
    z = np.random.default_rng(4).uniform(0, 10, (12, 15))
    r = raster.raster_from_array(spark, z, (0, 0, 15, 12))
    want = _flood(z, 1e-3)
    for tile in (5, 512):
        got = np.full(z.shape, np.nan)
        for x in terrain.fill_depressions(r, 1e-3, tile).collect():
            got[x.row, x.col] = x.value
        assert np.array_equal(got, want)
    filled = r.with_cells(spark.createDataFrame([(i, j, float(want[i, j])) for i in range(12) for j in range(15)], "row long, col long, value double"))
    d = terrain.d8_flow_direction(filled)
    assert d.where("direction = 0 and row between 1 and 10 and col between 1 and 13").count() == 0
    recv = terrain.receivers(d, 15)
    acc = {x.cell: x.acc for x in terrain.flow_accumulation(recv).collect()}
    pits = [x.cell for x in recv.where("recv is null").collect()]
    assert sum(acc[p] for p in pits) == 180
    top = max(pits, key=acc.get)
    mask = terrain.catchment(recv, top).where("inside = 1")
    assert mask.count() == acc[top]
    rings = terrain.mask_to_rings(mask.selectExpr("cell div 15 as row", "cell % 15 as col"))
    area = abs(sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:], strict=False)) / 2 for g in rings))
    assert area <= acc[top] + 1e-9 and rings


def test_raster_files(spark, tmp_path):
    z = np.arange(300 * 280, dtype=float).reshape(300, 280)
    z[3, 4] = np.nan
    grid = raster.GridSpec.from_bounds(300, 280, (500000, 4400000, 528000, 4430000), 32615)
    (tmp_path / "a.tif").write_bytes(geo.encode_tiff(z, grid))
    r = geo.read_raster(spark, str(tmp_path / "a.tif"))
    assert r.grid.bounds == pytest.approx(grid.bounds) and r.grid.crs == 32615
    assert r.valid().count() == z.size - 1 and r.cells.where("row = 299 and col = 279").first().value == z[299, 279]
    pts = spark.createDataFrame([(1, 0.5, 1.5)], "id long, x double, y double")
    geo.write_gpkg(pts, str(tmp_path / "a.gpkg"), "pts")
    assert geo.read_gpkg(spark, str(tmp_path / "a.gpkg")).select("id", "x", "y").first() == (1, 0.5, 1.5)
    geo.write_geojson(pts.withColumn("c", F.array("x", "y")), str(tmp_path / "a.json"), "Point", "c", ["id"])
    assert geo.read_geojson(spark, str(tmp_path / "a.json")).first().properties == {"id": "1"}


def test_grid_csv(spark, tmp_path):
    for y in (2017015, 2017200):
        (tmp_path / f"A{y}_chlor_a.csv").write_text("longitude,10.0,11.0\n1.0,0.5,\n2.0,,0.25\n")
    g = tabular.read_grid_csvs(spark, [str(p) for p in tmp_path.glob("*.csv")], "chlor_")
    assert sorted(g.columns) == ["chlor_2017015", "chlor_2017200", "latitude", "longitude"] and g.count() == 2
    with pytest.raises(ValueError):
        tabular.read_grid_csvs(spark, [])


def test_polygons(spark):
    z = spark.sql("select 7 as zone_id, array(struct(0D as x, 0D as y), struct(10D as x, 0D as y), struct(0D as x, 10D as y), struct(0D as x, 0D as y)) as ring")
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 8.0, 8.0)], "pos_id long, x double, y double")
    assert {r.pos_id: r.zone_id for r in assign_polygons(p, z, 4.0).collect()} == {1: 7, 2: None}


def test_planted_hotspot(spark):
    lat = HexLattice.over((0, 0, 20000, 20000), 1000.0)
    near = "pow(centroid_x - 10000, 2) + pow(centroid_y - 10000, 2) <= 3500 * 3500"
    v = lat.cells(spark).selectExpr("hex_id as id", f"{near} as planted", f"(hex_id * 7919 % 101) / 50.0D - 1 + if({near}, 6, 0) as x").cache()
    e = lat.neighbours(lat.cells(spark)).withColumn("w", F.lit(1.0))
    h = spatial.hotspots(v.select("id", "x"), ["x"], e, permutations=49).join(v.select("id", "planted"), "id")
    hot = F.col("x_gi_class").startswith("hot").cast("int")
    s = h.agg(F.avg(F.when(F.col("planted"), hot)), F.avg(F.when(~F.col("planted"), hot))).first()
    assert s[0] > 0.8 and s[1] < 0.15
    m = spatial.lisa_clusters(v.select("id", "x"), e, 49).join(v.select("id", "planted"), "id").where("planted")
    assert m.where("lisa_class = 'HH'").count() / m.count() > 0.6


def test_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=500) * 0.1
    df = spark.createDataFrame([(float(c), float(a), float(b)) for (a, b), c in zip(x, y, strict=True)], "y double, a double, b double")
    r = regression.fit_ols(df, "y", ["a", "b"])
    full = np.column_stack([np.ones(500), x])
    inv = np.linalg.inv(full.T @ full)
    beta = inv @ full.T @ y
    h = np.einsum("ij,jk,ik->i", full, inv, full)
    cov = inv @ (full.T * ((y - full @ beta) / (1 - h)) ** 2) @ full @ inv
    assert np.allclose(r.estimate, beta) and np.allclose(r.std_error, np.sqrt(np.diag(cov)))
    lasso = regression.fit_regularized_ols(df, "y", ["a", "b"], alpha=5.0, l1_wt=1.0)
    assert lasso.kind == "lasso" and lasso.metrics["n_nonzero"] == 0


def test_models(spark):
    df = spark.range(200).selectExpr("id as key", "id % 17 * 1.0D as a", "if(id % 3 = 0, 'u', 'v') as c", "id % 17 * 2.0D + if(id % 3 = 0, 5, 0) as y")
    board = learning.compare_models(df, "y", ["a"], ["c"], ("linear", "lasso"), cv=3).collect()
    assert board[0].rmse_cv <= board[1].rmse_cv and board[0].r2_cv > 0.9
    best, found = learning.tune_model(df, "ridge", "y", ["a"], ["c"], n_iter=2, cv=2)
    assert found.count() == 2
    imp = learning.permutation_importances(best, df, "y", ["a", "c"], 1).collect()
    assert imp[0].column == "a"
    with pytest.raises(ImportError):
        learning.tune_model(df, "ridge", "y", ["a"], backend="tpe")


def test_encoding(spark):
    df = spark.createDataFrame([("east", 1, 0.5, "x"), ("mid", 2, 1.5, "x"), ("west", 3, 2.5, None), (None, 4, 3.5, "x")], "port string, id long, v double, one string")
    out, made = encoding.one_hot_encode(df, ["port"])
    assert made == {"port": ["port_mid", "port_west"]} and out.where("id = 4").first().port_mid is None
    roles = {r.column: r.role for r in encoding.role_frame(df, float_category_limit=2).collect()}
    assert roles == {"port": "categorical", "id": "identifier", "v": "continuous", "one": "drop"}


def test_linear_scores(spark):
    """All linear models on all folds against numpy fits fold by fold; nulls are imputed by the training rows' medians."""
    import numpy as np

    from lattis.operators import learning

    rng = np.random.default_rng(2)
    n = 400
    x, c = rng.normal(size=(n, 2)) * [3, 0.5] + [10, -1], rng.integers(0, 3, n)
    y = x @ [2.0, -7.0] + c * 1.5 + rng.normal(size=n)
    gone = rng.random(n) < 0.1
    rows = [(i, None if gone[i] else float(x[i, 0]), float(x[i, 1]), "abc"[c[i]], float(y[i])) for i in range(n)]
    df = learning.with_folds(spark.createDataFrame(rows, "key long, a double, b double, c string, y double"), ["key"], 3)
    fold = np.array([r.fold for r in df.orderBy("key").collect()])
    models = {"linear": {}, "ridge": {"alpha": 20.0}, "lasso": {"alpha": 0.3}, "elastic_net": {"alpha": 0.2, "l1_ratio": 0.3}}
    got = {r["model"]: r for r in learning.linear_scores(df, "y", ["a", "b"], ["c"], models, 3)}
    for name, params in models.items():
        rmse = []
        for k in range(3):
            train, a = fold != k, x[:, 0].copy()
            a[gone] = np.sort(a[train & ~gone])[(train & ~gone).sum() // 2 - (0 if (train & ~gone).sum() % 2 else 1)]
            num = np.stack([a, x[:, 1]], axis=1)
            num = (num - num[train].mean(axis=0)) / num[train].std(axis=0, ddof=1)
            z = np.column_stack([num, c == 0, c == 1, c == 2, np.ones(n)]).astype(float)
            alpha, l1 = learning.LINEAR[name](train.sum(), **params)
            t, b = z[train], np.zeros(6)
            for _ in range(4000 if name != "linear" else 0):  # plain proximal steps on the rows
                step = 1 / np.linalg.eigvalsh(t.T @ t / len(t) + alpha * (1 - l1) * np.eye(6))[-1]
                pen = np.append(np.full(5, alpha), 0)
                b = b - step * (t.T @ (t @ b - y[train]) / len(t) + pen * (1 - l1) * b)
                b = np.sign(b) * np.maximum(np.abs(b) - step * pen * l1, 0)
            if name == "linear":
                b = np.linalg.lstsq(t, y[train], rcond=None)[0]
            rmse.append(np.sqrt(np.mean((y[~train] - z[~train] @ b) ** 2)))
        assert abs(got[name]["rmse_cv"] - np.mean(rmse)) < 2e-3 * np.mean(rmse), name


def test_importances_keep_nulls(spark):
    """Shuffling moves nulls and values, and changes the number of neither."""
    from lattis.operators import learning

    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, cast(id % 7 as double)) as x")
    seen = []

    class Model:
        def transform(self, d):
            seen.append(d.where("x is null").count())
            return d.selectExpr("*", "0D as prediction", "1D as y")

    learning.permutation_importances(Model(), df, "y", ["x"], n_repeats=2)
    assert seen == [667] * 3
