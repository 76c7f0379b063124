"""Points and gridded tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points_from_xy(df: DataFrame, lon: str = "longitude", lat: str = "latitude", drop_xy: bool = False) -> DataFrame:
    """Rows with both coordinates, as x and y."""
    if missing := [c for c in (lon, lat) if c not in df.columns]:
        raise KeyError(f"missing columns {missing}")
    df = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"x": F.col(lon).cast("double"), "y": F.col(lat).cast("double")})
    return df.drop(*[c for c in (lon, lat) if c not in ("x", "y")]) if drop_xy else df


def read_points(spark: SparkSession, path: str, lon: str = "longitude", lat: str = "latitude", columns: list[str] | None = None) -> DataFrame:
    """Parquet (.parquet, .pq, .geoparquet) or CSV; only the named columns are read."""
    df = spark.read.parquet(path) if re.search(r"\.(parquet|pq|geoparquet)/?$", path) else spark.read.csv(path, header=True, inferSchema=True)
    return points_from_xy(df.select(*dict.fromkeys([*columns, lon, lat])) if columns else df, lon, lat)


def value_name_from_filename(path: str, prefix: str = "", pattern: str = r"\d{4}\d{3}") -> str:
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])
    m = re.search(pattern, stem)
    return prefix + (m[0] if m else stem)


def melt_grid(wide: DataFrame, value_name: str = "value", first_axis: str = "longitude", second_axis: str = "latitude") -> DataFrame:
    """A wide grid (first axis in the first column, the second in the other headers) as rows; empty cells are left out."""
    first, *rest = wide.columns
    w = wide.select(F.expr(f"try_cast(`{first}` as double)").alias(first), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in rest])
    long = w.unpivot([f"`{first}`"], [f"`{c}`" for c in rest], second_axis, value_name).withColumnRenamed(first, first_axis)
    return long.withColumn(second_axis, F.expr(f"try_cast(`{second_axis}` as double)")).dropna()


def read_grid_csv(spark: SparkSession, path: str, value_name: str | None = None) -> DataFrame:
    return melt_grid(spark.read.csv(path, header=True), value_name or value_name_from_filename(path))


def outer_join_grids(long: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(longitude, latitude, name, value) -> a column a name: the full outer join of all grids on exact coordinates in one shuffle."""
    return long.groupBy("longitude", "latitude").pivot("name", names).agg(F.first("value"))


def read_grid_csvs(spark: SparkSession, paths: list[str], prefix: str = "", limit: int | None = None) -> DataFrame:
    paths = sorted(paths)[:limit]
    if not paths:
        raise ValueError("no files")
    out, names = None, []
    for p in paths:
        names.append(value_name_from_filename(p, prefix))
        part = read_grid_csv(spark, p, "value").withColumn("name", F.lit(names[-1]))
        out = part if out is None else out.unionByName(part)
    return outer_join_grids(out, names)


def read_many(spark: SparkSession, paths: list[str], clean: Callable | None = None, schema: str | None = None) -> DataFrame:
    """All files that aren't empty, in the first one's format; clean (an iterator of pandas frames to one) runs per partition."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    paths = [p for p in sorted(paths) if path(p).getFileSystem(conf).getFileStatus(path(p)).getLen() or path(p).getFileSystem(conf).getFileStatus(path(p)).isDirectory()]
    if not paths:
        raise FileNotFoundError("no files with content")
    df = spark.read.parquet(*paths) if re.search(r"\.(parquet|pq)/?$", paths[0]) else spark.read.csv(paths, header=True, inferSchema=True)
    return df.mapInPandas(clean, schema or df.schema) if clean else df
