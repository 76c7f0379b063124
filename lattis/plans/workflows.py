"""Queries: the hydrology, oceanography and maritime workflows end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import carriers
from ..sources.carriers import table
from . import covariates, voyage, watershed
from .relational import _HEX_SMALL, RADIUS

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


_OBS = """pos AS (SELECT o_orderkey AS pos_id, CAST((o_custkey * o_custkey * 31 + o_custkey * 7919) % 20011 AS DOUBLE) AS x, CAST((o_custkey * o_custkey * 17 + o_custkey * 613) % 20011 AS DOUBLE) AS y,
  CAST(year(o_orderdate) AS INT) AS year, CAST(dayofyear(o_orderdate) AS INT) AS doy, o_totalprice AS value FROM orders)"""
_SER = f"{_OBS}, {_HEX_SMALL}, ser AS (SELECT hex_id, year, doy, avg(value) AS value FROM near JOIN pos USING (pos_id) GROUP BY ALL)"
_MEANS = f"{_SER}, ys AS (SELECT hex_id, year, CASE WHEN doy < 104 OR doy >= 288 THEN 'winter' ELSE 'summer' END AS season, avg(value) AS mean FROM ser GROUP BY ALL)"


def _observations(spark, sf):
    o = table(spark, sf, "orders")
    x, y = F.expr("cast((o_custkey * o_custkey * 31 + o_custkey * 7919) % 20011 as double)"), F.expr("cast((o_custkey * o_custkey * 17 + o_custkey * 613) % 20011 as double)")
    return o.select(x.alias("x"), y.alias("y"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"), F.col("o_totalprice").alias("value"))


@query(f"""WITH {_MEANS}, yo AS (SELECT a.hex_id, a.season, a.year, (a.mean - b.mean) / nullif(b.mean, 0) AS change FROM ys a JOIN ys b ON a.hex_id = b.hex_id AND a.season = b.season AND b.year = a.year - 1),
  m AS (SELECT hex_id, avg(mean) FILTER (season = 'winter') AS winter_mean, avg(mean) FILTER (season = 'summer') AS summer_mean, avg(mean) AS total_mean FROM ys GROUP BY hex_id),
  v AS (SELECT hex_id, var_samp(change) FILTER (season = 'winter') AS winter_var, var_samp(change) FILTER (season = 'summer') AS summer_var FROM yo GROUP BY hex_id)
  SELECT m.hex_id, round(winter_mean, 4) AS winter_mean, round(summer_mean, 4) AS summer_mean, round(total_mean, 4) AS total_mean, round(winter_var, 6) AS winter_var, round(summer_var, 6) AS summer_var FROM m LEFT JOIN v USING (hex_id)""")
def hex_covariates(spark, sf):
    t = covariates.build_covariates(_observations(spark, sf), radius=RADIUS).table
    return t.select("hex_id", *[F.round(f"{c}_mean", 4).alias(f"{c}_mean") for c in ("winter", "summer", "total")], *[F.round(f"{c}_var", 6).alias(f"{c}_var") for c in ("winter", "summer")])


@query()
def oceanography_hotspots(spark, sf):
    c = covariates.build_covariates(_observations(spark, sf), radius=RADIUS)
    return covariates.screen(c, ["total_mean"], weights="queen", permutations=99)


def _watershed(spark, sf):
    r = carriers.raster(spark, sf)
    return watershed.run_watershed([r], (25.5, -2.5), stream_cells=2, min_cells=1)


@query()
def watershed_stats(spark, sf):
    return spark.createDataFrame(sorted((k, float(v)) for k, v in _watershed(spark, sf).stats.items()), "name string, value double")


@query()
def watershed_flowlines(spark, sf):
    return _watershed(spark, sf).lines.drop("path")


@query()
def maritime_models(spark, sf):
    i = table(spark, sf, "lineitem").drop("l_comment")
    v = voyage.run_voyage(i, "l_extendedprice", "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), models=("linear", "ridge"), cv=2, n_iter=2, repeats=1)
    return spark.createDataFrame(sorted((k, float(x)) for k, x in v.stats.items()), "name string, value double")
