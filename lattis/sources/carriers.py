"""The driver's tables as positions, rasters, series, zones and lines, by integer arithmetic that DuckDB repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import epoch_seconds
from ..operators.raster import GridSpec, Raster

COLS = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("a", F.expr("event_id % 20011")).withColumn("u", F.expr("user_id % 20011"))
    return e.select(
        F.col("event_id").alias("pos_id"), F.col("user_id").alias("track"), "ts", epoch_seconds("ts").alias("t"), F.col("value").alias("alt"),
        F.expr("cast((a * a % 20011 * 31 + u * 7919) % 20011 as double)").alias("x"), F.expr("cast((a * a % 20011 * 17 + a * 104729 + u * 613) % 20011 as double)").alias("y"),
        F.expr("cast(60 + user_id % 80 as double)").alias("speed"),
    )


def raster(spark: SparkSession, sf: str) -> Raster:
    p = table(spark, sf, "part")
    n = (p.agg(F.max("p_partkey")).first()[0] or 0) // COLS + 1
    cells = p.select(F.expr(f"p_partkey div {COLS}").alias("row"), F.expr(f"p_partkey % {COLS}").alias("col"), (F.col("p_retailprice") + 3 * F.col("p_size")).alias("value"))
    return Raster(cells, GridSpec(n, COLS, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0))


def series(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 25).alias("cell"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"), F.col("o_totalprice").alias("value"))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("n", F.col("n_nationkey").cast("long"))
    return n.select(F.col("n").alias("zone_id"), F.expr("cast(n % 5 * 10 as double)").alias("x0"), F.expr("cast(-8 - n div 5 * 8 as double)").alias("y0"), F.expr("cast(n % 5 * 10 + 9 as double)").alias("x1"), F.expr("cast(-(n div 5) * 8 + 1 as double)").alias("y1"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("n", F.col("n_nationkey").cast("long"))
    return n.select(F.col("n").alias("line_id"), F.expr("array(struct(n + 0.25D as x, -0.75D as y), struct(n + 10.25D as x, -(n % 7) - 1.25D as y), struct(n + 3.25D as x, -(n % 11) - 2.5D as y))").alias("path"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


POSITIONS = """pos AS (SELECT event_id AS pos_id, user_id AS track, ts, epoch_us(ts) / 1e6 AS t, value AS alt,
  CAST((event_id * event_id * 31 + user_id * 7919) % 20011 AS DOUBLE) AS x, CAST((event_id * event_id * 17 + event_id * 104729 + user_id * 613) % 20011 AS DOUBLE) AS y,
  CAST(60 + user_id % 80 AS DOUBLE) AS speed FROM events)"""
RASTER = f"ras AS (SELECT p_partkey // {COLS} AS r, p_partkey % {COLS} AS c, p_retailprice + 3 * p_size AS z FROM part)"
SERIES = "ser AS (SELECT o_custkey % 25 AS cell, CAST(year(o_orderdate) AS INT) AS year, CAST(dayofyear(o_orderdate) AS INT) AS doy, o_totalprice AS value FROM orders)"
ZONES = "zon AS (SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_nationkey % 5 * 10.0::DOUBLE AS x0, -8.0::DOUBLE - n_nationkey // 5 * 8 AS y0, n_nationkey % 5 * 10.0::DOUBLE + 9 AS x1, -(n_nationkey // 5) * 8.0::DOUBLE + 1 AS y1 FROM nation)"
LINES = """lin AS (SELECT CAST(n_nationkey AS BIGINT) AS line_id, unnest([0, 1, 2]) AS k, unnest([n_nationkey + 0.25::DOUBLE, n_nationkey + 10.25::DOUBLE, n_nationkey + 3.25::DOUBLE]) AS x,
  unnest([-0.75::DOUBLE, -(n_nationkey % 7) - 1.25::DOUBLE, -(n_nationkey % 11) - 2.5::DOUBLE]) AS y FROM nation)"""
VECTORS = "vec AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
