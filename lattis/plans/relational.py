"""Queries: filters, time, proximity, hexagons, tests, classes and seasons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hexgrid import HexLattice
from ..functions.temporal import add_hour_and_day_night, hour_bins, time_windows
from ..operators import encoding, inference, learning, proximity, seasonal
from ..operators.cells import points_to_cells
from ..sources import tabular
from ..sources.carriers import POSITIONS, SERIES, positions, series, table

QUERIES: dict = {}
ORACLES: dict = {}
CONFIG = proximity.ProximityConfig(3000, 50, 600)
RADIUS = 1500.0


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rounded(name: str, digits: int):
    """A column of numbers from 0 on, rounded half up. F.round goes through decimals, which takes most of the time where rows are many."""
    m = 10.0**digits
    return F.expr(f"if(isnan({name}), {name}, floor({name} * {m}D + 0.5D) / {m}D)").alias(name)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45")
def read_prune_filter(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01 00:00:00' and l_quantity > 45").select("l_orderkey", "l_quantity")


def kept_positions(spark, sf):
    from .airspace import AirspaceFilter, filter_positions

    return filter_positions(positions(spark, sf), AirspaceFilter(hours=(7, 19), altitude=(0, 500), min_speed=80, bbox=(1000, 1000, 18000, 19000)))


_KEPT = "hour(ts) >= 7 AND hour(ts) < 19 AND alt BETWEEN 0 AND 500 AND speed >= 80 AND x BETWEEN 1000 AND 18000 AND y BETWEEN 1000 AND 19000"


@query(f"WITH {POSITIONS} SELECT pos_id, track, alt FROM pos WHERE {_KEPT}")
def filter_positions(spark, sf):
    return kept_positions(spark, sf).select("pos_id", "track", "alt")


@query(f"WITH {POSITIONS} SELECT CAST(hour(ts) AS INT) AS hour, hour(ts) >= 20 OR hour(ts) <= 6 AS is_night, count(*) AS n FROM pos GROUP BY ALL")
def hour_day_night(spark, sf):
    return add_hour_and_day_night(positions(spark, sf), "ts").groupBy("hour", "is_night").agg(F.count("*").alias("n"))


@query(f"WITH {POSITIONS} SELECT CASE WHEN hour(ts) < 6 THEN '[0, 6)' WHEN hour(ts) < 12 THEN '[6, 12)' WHEN hour(ts) < 18 THEN '[12, 18)' ELSE '[18, 24)' END AS bin, count(*) AS n FROM pos GROUP BY ALL")
def hour_bins_counts(spark, sf):
    return positions(spark, sf).groupBy(hour_bins(F.hour("ts")).alias("bin")).agg(F.count("*").alias("n"))


_PAIRS = f"""{POSITIONS}, prs AS (SELECT a.pos_id AS i, b.pos_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, abs(a.t - b.t) AS dt, least(a.t, b.t) AS t0
  FROM pos a JOIN pos b ON a.pos_id < b.pos_id AND a.track <> b.track AND b.t BETWEEN a.t - 600 AND a.t + 600 AND abs(a.alt - b.alt) <= 50
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3000),
  cnt AS (SELECT p.*, coalesce(n, 0) AS event_count FROM pos p LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT i AS k FROM prs UNION ALL SELECT j FROM prs) GROUP BY k) ON k = pos_id)"""


@query(f"WITH {_PAIRS} SELECT i, j, round(d, 4) AS distance_m, round(dt, 4) AS dt_s FROM prs")
def proximity_pairs(spark, sf):
    return proximity.proximity_pairs(positions(spark, sf), CONFIG).select("i", "j", rounded("distance_m", 4), rounded("dt_s", 4))


@query(f"WITH {_PAIRS} SELECT pos_id, CAST(event_count AS BIGINT) AS event_count FROM cnt")
def proximity_counts(spark, sf):
    return proximity.proximity_counts(positions(spark, sf), CONFIG).select("pos_id", "event_count")


@query(f"WITH {_PAIRS} SELECT CAST(floor((t0 - (SELECT min(t) FROM pos)) / 3600) AS BIGINT) AS window_id, count(*) AS pairs FROM prs GROUP BY ALL")
def proximity_windowed(spark, sf):
    return proximity.window_counts(positions(spark, sf), CONFIG, 3600)


@query(f"""WITH {_PAIRS} SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS reports, CAST(sum(event_count) AS BIGINT) AS events, count(DISTINCT track) AS tracks,
  round(1000.0 * sum(event_count) / count(*), 4) AS events_per_1k_reports FROM cnt GROUP BY ALL""")
def hourly_profile(spark, sf):
    from .airspace import hourly_profile as profile

    p = profile(proximity.proximity_counts(positions(spark, sf), CONFIG))
    return p.withColumn("events_per_1k_reports", F.round("events_per_1k_reports", 4))


@query(f"""WITH {POSITIONS}, lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM pos), w AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS s FROM lim)
  SELECT s - INTERVAL 1 HOUR AS window_start, s + INTERVAL 25 HOUR AS window_end FROM w""")
def time_windows_padded(spark, sf):
    return time_windows(positions(spark, sf), "ts", "1 day", "1 hour")


_GAPS = f"{POSITIONS}, gap AS (SELECT t - lag(t) OVER (PARTITION BY track ORDER BY t) AS g FROM pos)"


@query(f"WITH {_GAPS} SELECT round(coalesce(sum(g) FILTER (g <= 600), 0) / 3600, 6) AS hours FROM gap")
def exposure_hours(spark, sf):
    return proximity.exposure_hours(positions(spark, sf)).select(F.round("hours", 6).alias("hours"))


@query(f"WITH {_GAPS} SELECT round(greatest(1, coalesce(median(g), 1)), 4) AS seconds FROM gap")
def median_report_interval(spark, sf):
    return proximity.median_report_interval(positions(spark, sf)).select(F.round("seconds", 4).alias("seconds"))


@query(f"""WITH {_PAIRS}, t AS (SELECT track, CAST(sum(event_count) AS BIGINT) AS events, (max(t) - min(t)) / 3600 AS hours FROM cnt GROUP BY track)
  SELECT track, events, events > 0 AND events / greatest(hours, 1e-9) > 0.02 AS unacceptable FROM t""")
def flag_unacceptable(spark, sf):
    c = proximity.proximity_counts(positions(spark, sf), CONFIG).groupBy("track").agg(F.sum("event_count").alias("events"), ((F.max("t") - F.min("t")) / 3600).alias("hours"))
    return c.select("track", "events", proximity.flag_unacceptable(F.col("events"), F.col("hours"), 0.02).alias("unacceptable"))


_W, _H = math.sqrt(3) * RADIUS, 2 * RADIUS
_LAT = f"""lat AS (SELECT min(x) - {_W!r} AS x0, min(y) - {_H!r} AS y0, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1,
  CAST(ceil(((max(y) + {_H!r}) - (min(y) - {_H!r})) / {1.5 * RADIUS!r}) + 1 AS BIGINT) AS nr, CAST(ceil(((max(x) + {_W!r}) - (min(x) - {_W!r})) / {_W!r}) + 1 AS BIGINT) AS nc FROM pos),
  cells AS (SELECT r * nc + c AS hex_id, r AS "row", c AS col, x0 + c * {_W!r} + (r % 2) * {_W / 2!r} AS cx, y0 + r * {1.5 * RADIUS!r} AS cy, lat.* FROM lat, range(10000) a(r), range(10000) b(c) WHERE r < nr AND c < nc)"""
_HEX = f"""{_LAT}, near AS (SELECT p.pos_id, arg_min(hex_id, ((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy), hex_id)) AS hex_id
  FROM pos p JOIN cells ON cy BETWEEN p.y - {RADIUS!r} AND p.y + {RADIUS!r} AND cx BETWEEN p.x - {RADIUS!r} AND p.x + {RADIUS!r} GROUP BY p.pos_id)"""


def lattice(spark, sf) -> HexLattice:
    return HexLattice.for_points(positions(spark, sf), radius=RADIUS)


_LAT_SMALL = _LAT.replace("range(10000)", "range(40)")
_HEX_SMALL = _HEX.replace("range(10000)", "range(40)")


@query(f'WITH {POSITIONS}, {_LAT_SMALL} SELECT hex_id, "row", col, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y FROM cells')
def hex_grid(spark, sf):
    return lattice(spark, sf).cells(spark).select("hex_id", "row", "col", F.round("centroid_x", 4).alias("centroid_x"), F.round("centroid_y", 4).alias("centroid_y"))


_SIN = math.sqrt(3) / 2


@query(f"""WITH {POSITIONS}, {_LAT_SMALL}, k AS (SELECT *, cx - (bx0 + bx1) / 2 AS dx, cy - (by0 + by1) / 2 AS dy, (bx1 - bx0) / 2 AS hx, (by1 - by0) / 2 AS hy FROM cells)
  SELECT row_number() OVER (ORDER BY "row", col) - 1 AS hex_id, "row", col FROM k WHERE abs(dx) <= hx + {_W / 2!r} AND abs(dy) <= hy + {RADIUS!r}
  AND abs(dx * 0.5 + dy * {_SIN!r}) <= hx * 0.5 + hy * {_SIN!r} + {_W / 2!r} AND abs(dx * 0.5 - dy * {_SIN!r}) <= hx * 0.5 + hy * {_SIN!r} + {_W / 2!r}""")
def hex_grid_clipped(spark, sf):
    return lattice(spark, sf).cells(spark, clip=True).select("hex_id", "row", "col")


@query(f"WITH {POSITIONS}, {_HEX_SMALL} SELECT pos_id, hex_id FROM near")
def assign_hex(spark, sf):
    return lattice(spark, sf).place(positions(spark, sf)).select("pos_id", "hex_id")


@query(f"""WITH {POSITIONS}, {_HEX_SMALL}, s AS (SELECT hex_id, count(*) AS n, avg(alt) AS alt, avg(speed) AS speed FROM near JOIN pos USING (pos_id) GROUP BY hex_id)
  SELECT cells.hex_id, coalesce(n, 0) AS n_points, round(alt, 7) AS alt, round(speed, 7) AS speed FROM cells LEFT JOIN s USING (hex_id)""")
def points_to_cells_mean(spark, sf):
    c = points_to_cells(positions(spark, sf), lattice(spark, sf), "mean", ["alt", "speed"])
    return c.select("hex_id", "n_points", F.round("alt", 7).alias("alt"), F.round("speed", 7).alias("speed"))


@query(f"""WITH {POSITIONS}, {_HEX_SMALL} SELECT hex_id, count(*) AS n_points, round(sum(alt), 4) AS alt_sum, round(stddev_samp(alt), 4) AS alt_std, round(median(alt), 4) AS alt_median, min(speed) AS speed_min, max(speed) AS speed_max,
  count(DISTINCT track) AS track_nunique FROM near JOIN pos USING (pos_id) GROUP BY hex_id""")
def points_to_cells_multi_agg(spark, sf):
    c = points_to_cells(positions(spark, sf), lattice(spark, sf), {"alt": ["sum", "std", "median"], "speed": ["min", "max"], "track": ["nunique"]}, keep_empty=False)
    return c.select("hex_id", "n_points", *[F.round(f"alt_{a}", 4).alias(f"alt_{a}") for a in ("sum", "std", "median")], "speed_min", "speed_max", "track_nunique")


_CELLS = f"""{_PAIRS}, {_HEX_SMALL}, agg AS (SELECT cells.hex_id, coalesce(n, 0) AS n_points, coalesce(ev, 0) AS events, 1000.0 * ev / n AS rate
  FROM cells LEFT JOIN (SELECT hex_id, count(*) AS n, CAST(sum(event_count) AS BIGINT) AS ev FROM near JOIN cnt USING (pos_id) GROUP BY hex_id) USING (hex_id)),
  b AS (SELECT min(events) AS lo, max(events) AS hi, least(3, count(DISTINCT events)) AS k FROM agg)"""
_CLASS = "CASE WHEN events = 0 THEN 0 WHEN k > 1 AND events <= lo + (hi - lo) * 1 / k THEN 0 WHEN k > 2 AND events <= lo + (hi - lo) * 2 / k THEN 1 ELSE k - 1 END"


@query(f"""WITH {_CELLS} SELECT hex_id, n_points, CAST(events AS BIGINT) AS event_count, round(rate, 4) AS events_per_1k_reports, CAST({_CLASS} AS INT) AS risk_level,
  ['low', 'medium', 'high'][CAST({_CLASS} AS INT) + 1] AS risk_label FROM agg, b""")
def summarise_cells(spark, sf):
    from .airspace import summarise_cells as summarise

    c = summarise(proximity.proximity_counts(positions(spark, sf), CONFIG), lattice(spark, sf), scheme="equal_interval")
    return c.select("hex_id", "n_points", "event_count", F.round("events_per_1k_reports", 4).alias("events_per_1k_reports"), "risk_level", "risk_label")


def user_counts(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))


_USERS = "usr AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"
_SF = "greatest(0, least(1, 1 - coalesce((SELECT sum(exp(-lam + i * ln(lam) - lgamma(i + 1))) FROM range(400) r(i) WHERE i < n), 0)))"
_BH = "least(1, min(p * m / r) OVER (ORDER BY p DESC, r DESC ROWS UNBOUNDED PRECEDING))"


def _adjusted(src: str, p: str) -> str:
    return f"adj AS (SELECT *, {_BH} AS q FROM (SELECT *, {p} AS p, count(*) OVER () AS m, rank() OVER (ORDER BY {p}) + count(*) OVER (PARTITION BY {p}) - 1 AS r FROM {src}))"


@query(f"WITH {_USERS}, a AS (SELECT *, avg(n) OVER () AS lam FROM usr), s AS (SELECT user_id, n, lam, {_SF} AS pv FROM a), {_adjusted('s', 'pv')} SELECT user_id, n, round(lam, 4) AS expected, round(p, 5) AS p_value, round(q, 5) AS p_adjusted, q < 0.05 AS significant FROM adj")
def poisson_excess(spark, sf):
    r = inference.poisson_excess(user_counts(spark, sf), "n")
    return r.select("user_id", "n", F.round("expected", 4).alias("expected"), F.round("p_value", 5).alias("p_value"), F.round("p_adjusted", 5).alias("p_adjusted"), "significant")


@query(f"WITH {_USERS}, s AS (SELECT user_id, n, 1.0 + user_id % 7 AS ex, 12.0 * (1 + user_id % 7) AS lam FROM usr) SELECT user_id, n, CAST(lam AS DOUBLE) AS expected, round({_SF}, 5) AS p_value, round(n / ex, 5) AS observed_rate FROM s")
def poisson_rate(spark, sf):
    c = user_counts(spark, sf).withColumn("exposure", F.expr("cast(1 + user_id % 7 as double)"))
    return inference.poisson_rate(c, "n", "exposure", 12.0).select("user_id", "n", "expected", F.round("p_value", 5).alias("p_value"), F.round("observed_rate", 5).alias("observed_rate"))


@query(f"WITH s AS (SELECT o_orderkey, (o_orderkey * 37 % 997 + 1) / 1000.0::DOUBLE AS pv FROM orders), {_adjusted('s', 'pv')} SELECT o_orderkey, round(q, 6) AS p_adjusted, q < 0.05 AS significant FROM adj")
def benjamini_hochberg(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("(o_orderkey % 997 * 37 % 997 + 1) / 1000D").alias("p_value"))
    return inference.benjamini_hochberg(o).select("o_orderkey", F.round("p_adjusted", 6).alias("p_adjusted"), "significant")


_TABLE = """cel AS (SELECT event_type AS r, CAST(hour(ts) AS INT) AS c, CAST(count(*) AS DOUBLE) AS o FROM events GROUP BY ALL), rr AS (SELECT r, sum(o) AS rt FROM cel GROUP BY r),
  cc AS (SELECT c, sum(o) AS ct FROM cel GROUP BY c), ful AS (SELECT r, c, coalesce(o, 0) AS o, rt * ct / (SELECT sum(o) FROM cel) AS e FROM rr CROSS JOIN cc LEFT JOIN cel USING (r, c))"""


def hours_by_type(spark, sf):
    return table(spark, sf, "events").withColumn("hour", F.hour("ts"))


@query(f"WITH {_TABLE} SELECT round(sum((o - e) * (o - e) / e), 4) AS statistic, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS dof FROM ful")
def chi_square(spark, sf):
    r = inference.chi_square(hours_by_type(spark, sf), "event_type", "hour")
    return spark.createDataFrame([(round(float(r.statistic), 4), r.dof)], "statistic double, dof long")


@query(f"WITH {_TABLE} SELECT r AS event_type, c AS hour, o AS observed, round(e, 4) AS expected, round((o - e) / sqrt(e), 4) AS residual FROM ful")
def contingency_residuals(spark, sf):
    t = inference.contingency(hours_by_type(spark, sf), "event_type", "hour")
    return t.select(F.col("r").alias("event_type"), F.col("c").alias("hour"), "observed", F.round("expected", 4).alias("expected"), F.round("residual", 4).alias("residual"))


def _bounds(spark, sf, scheme, k):
    b = inference.class_bounds(table(spark, sf, "part"), "p_retailprice", k, scheme)
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(b)], "class int, bound double")


@query("SELECT CAST(i - 1 AS INT) AS class, round(quantile_cont(p_retailprice, i / 4.0), 4) AS bound FROM part, range(1, 5) r(i) GROUP BY i".replace("quantile_cont(p_retailprice, i / 4.0)", "CASE i WHEN 1 THEN quantile_cont(p_retailprice, 0.25) WHEN 2 THEN quantile_cont(p_retailprice, 0.5) WHEN 3 THEN quantile_cont(p_retailprice, 0.75) ELSE max(p_retailprice) END"))
def breaks_quantile(spark, sf):
    return _bounds(spark, sf, "quantiles", 4)


@query("SELECT CAST(i - 1 AS INT) AS class, round(min(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * i / 5, 4) AS bound FROM part, range(1, 6) r(i) GROUP BY i")
def breaks_equal_interval(spark, sf):
    return _bounds(spark, sf, "equal_interval", 5)


@query()
def breaks_natural(spark, sf):
    return _bounds(spark, sf, "natural_breaks", 4)


@query("""WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT p_partkey, CAST(CASE WHEN p_size = 0 OR p_size <= lo + (hi - lo) / 3.0 THEN 0 WHEN p_size <= lo + (hi - lo) * 2 / 3.0 THEN 1 ELSE 2 END AS INT) AS risk_level,
  CASE WHEN p_size = 0 OR p_size <= lo + (hi - lo) / 3.0 THEN 'low' WHEN p_size <= lo + (hi - lo) * 2 / 3.0 THEN 'medium' ELSE 'high' END AS risk_label FROM part, b""")
def risk_levels(spark, sf):
    return inference.risk_levels(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 3, "equal_interval").select("p_partkey", "risk_level", "risk_label")


def _wide(spark, sf):
    o = table(spark, sf, "orders").withColumn("longitude", F.col("o_custkey") % 25)
    return o.withColumn("band", F.col("o_orderkey") % 4).groupBy("longitude").pivot("band", [0, 1, 2, 3]).agg(F.max("o_totalprice"))


@query("SELECT CAST(o_custkey % 25 AS DOUBLE) AS longitude, CAST(o_orderkey % 4 AS DOUBLE) AS latitude, max(o_totalprice) AS chlor FROM orders GROUP BY ALL")
def grid_melt(spark, sf):
    return tabular.melt_grid(_wide(spark, sf), "chlor").select("longitude", "latitude", "chlor")


_YEARS = range(1992, 1999)  # all that orders has


@query(f"""SELECT CAST(o_custkey % 25 AS DOUBLE) AS longitude, CAST(o_orderkey % 10 AS DOUBLE) AS latitude, {", ".join(f"max(o_totalprice) FILTER (year(o_orderdate) = {y}) AS chlor_{y}" for y in _YEARS)}
  FROM orders GROUP BY ALL""")
def grid_outer_join(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    long = o.groupBy((F.col("o_custkey") % 25).cast("double").alias("longitude"), (F.col("o_orderkey") % 10).cast("double").alias("latitude"), F.concat(F.lit("chlor_"), F.col("y")).alias("name")).agg(F.max("o_totalprice").alias("value"))
    return tabular.outer_join_grids(long, [f"chlor_{y}" for y in _YEARS])


_YS = f"{SERIES}, ys AS (SELECT cell, year, CASE WHEN doy < 104 OR doy >= 288 THEN 'winter' ELSE 'summer' END AS season, avg(value) AS mean FROM ser GROUP BY ALL)"
_YOY = f"{_YS}, yoy AS (SELECT a.cell, a.year, a.season, (a.mean - b.mean) / nullif(b.mean, 0) AS change FROM ys a JOIN ys b ON a.cell = b.cell AND a.season = b.season AND a.year = b.year + 1)"


def ys(spark, sf):
    return seasonal.year_season_means(series(spark, sf), ["cell"])


@query(f"WITH {_YS} SELECT cell, year, season, round(mean, 7) AS mean FROM ys")
def year_season_means(spark, sf):
    return ys(spark, sf).withColumn("mean", F.round("mean", 7))


@query(f"WITH {_YS} SELECT cell, season, round(avg(mean), 4) AS mean FROM ys GROUP BY ALL UNION ALL SELECT cell, 'total', round(avg(mean), 4) FROM ys GROUP BY cell")
def seasonal_means(spark, sf):
    return seasonal.seasonal_means(ys(spark, sf), ["cell"]).withColumn("mean", F.round("mean", 4))


@query(f"WITH {_YOY} SELECT cell, year, season, round(change, 6) AS change FROM yoy")
def yoy_change(spark, sf):
    return seasonal.year_over_year(ys(spark, sf), ["cell"]).withColumn("change", F.round("change", 6))


@query(f"WITH {_YOY} SELECT cell, season, round(var_samp(change), 6) AS var FROM yoy GROUP BY ALL")
def seasonal_variance(spark, sf):
    return seasonal.seasonal_variance(seasonal.year_over_year(ys(spark, sf), ["cell"]), ["cell"]).withColumn("var", F.round("var", 6))


@query(f"WITH {_YOY} SELECT cell, year, round(var_samp(change), 6) AS var FROM yoy GROUP BY ALL")
def interannual_variance(spark, sf):
    return seasonal.interannual_variance(seasonal.year_over_year(ys(spark, sf), ["cell"]), ["cell"]).withColumn("var", F.round("var", 6))


@query("""SELECT 'o_orderkey' AS "column", 0.0::DOUBLE AS missing UNION ALL SELECT 'priority', round(avg((o_orderpriority = '1-URGENT')::INT), 6) FROM orders
  UNION ALL SELECT 'price', round(avg((o_totalprice > 100000)::INT), 6) FROM orders""")
def missingness(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '1-URGENT')").alias("priority"), F.expr("if(o_totalprice > 100000, double('NaN'), o_totalprice)").alias("price"))
    return seasonal.missingness(o).withColumn("missing", F.round("missing", 6))


_ROLE = """CASE WHEN n <= 1 OR nulls >= 0.9 THEN 'drop' WHEN n = 2 THEN 'boolean' WHEN kind = 's' THEN CASE WHEN n = m THEN 'identifier' WHEN len >= 30 THEN 'text' ELSE 'categorical' END
  WHEN kind = 'i' THEN CASE WHEN n = m THEN 'identifier' WHEN n <= 20 THEN 'categorical' ELSE 'continuous' END WHEN n <= 8 THEN 'categorical' ELSE 'continuous' END"""
_COLS = {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "s"}


@query(f"SELECT \"column\", {_ROLE} AS role FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(DISTINCT {c}) AS n, avg(({c} IS NULL)::INT) AS nulls, count(*) AS m, {f'avg(length({c}))' if k == 's' else '0'} AS len FROM customer" for c, k in _COLS.items()) + ")")
def classify_columns(spark, sf):
    return encoding.role_frame(table(spark, sf, "customer").select(*_COLS))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_nationkey, " + ", ".join(f"CAST(sum((c_mktsegment = '{s}')::INT) AS DOUBLE) AS \"{s}\"" for s in _SEGMENTS[1:]) + " FROM customer GROUP BY ALL")
def one_hot(spark, sf):
    df, made = encoding.one_hot_encode(table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"), ["c_mktsegment"])
    return df.groupBy("c_nationkey").agg(*[F.sum(f"`{c}`").alias(c.removeprefix("c_mktsegment_")) for c in made["c_mktsegment"]])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER () AS n FROM orders) WHERE r <= greatest(n // 5, 10)")
def holdout_split(spark, sf):
    return learning.holdout_split(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"])[1].select("o_orderkey")


@query(f"""WITH {POSITIONS} SELECT pos_id, round(-122 + x / 100000, 6) AS lon, round(37 + y / 100000, 6) AS lat, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, alt, CAST((alt > 50)::INT AS DOUBLE) AS high FROM pos""")
def kepler_layer_frame(spark, sf):
    from .kepler import prepare_frame

    p = positions(spark, sf).select("pos_id", (F.lit(-122) + F.col("x") / 100000).alias("lon"), (F.lit(37) + F.col("y") / 100000).alias("lat"), "ts", "alt", (F.col("alt") > 50).alias("high"))
    return prepare_frame(p, keep=["pos_id"]).withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})



@query(ORACLES["summarise_cells"])
def airspace_cells(spark, sf):
    from .airspace import AirspaceFilter, run_airspace

    r = run_airspace(positions(spark, sf), AirspaceFilter(None, None, None, None), CONFIG, radius=RADIUS, scheme="equal_interval")
    return r.cells.select("hex_id", "n_points", "event_count", F.round("events_per_1k_reports", 4).alias("events_per_1k_reports"), "risk_level", "risk_label")
