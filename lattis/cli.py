"""Command line: one subcommand a workflow (``python -m lattis.cli airspace positions.parquet --out folder``)."""

from __future__ import annotations

import argparse
import glob
import json
import os

from pyspark.sql import functions as F

from .functions.crs import reproject, suggest_metric_crs
from .functions.temporal import epoch_seconds
from .runtime import ensure_dir, export_dir, get_logger, get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattis", description="Geo-analytics workflows on Spark.")
    sub = p.add_subparsers(dest="workflow", required=True)
    h = sub.add_parser("hydrology", help="catchment and flowlines above a pour point")
    h.add_argument("tiles", nargs="+", help="GeoTIFF elevation tiles")
    h.add_argument("--x", type=float, required=True)
    h.add_argument("--y", type=float, required=True)
    h.add_argument("--lines", type=int, default=12)
    o = sub.add_parser("oceanography", help="seasonal covariates and hotspots of gridded CSV files")
    o.add_argument("files", nargs="+")
    o.add_argument("--radius", type=float)
    o.add_argument("--attribute", action="append", default=[])
    o.add_argument("--method", choices=("getis_ord", "local_moran"), default="getis_ord")
    o.add_argument("--permutations", type=int, default=999)
    a = sub.add_parser("airspace", help="proximity events in hexagons")
    a.add_argument("positions")
    a.add_argument("--horizontal", type=float, default=None, help="metres")
    a.add_argument("--minutes", type=float, default=5)
    m = sub.add_parser("maritime", help="models of vessel telemetry")
    m.add_argument("telemetry")
    m.add_argument("--target", required=True)
    m.add_argument("--time", default="timestamp")
    m.add_argument("--model", action="append", default=[])
    m.add_argument("--iterations", type=int, default=20)
    for s in (h, o, a, m):
        s.add_argument("--out")
    return p


def _metric(df, lon="longitude", lat="latitude"):
    box = df.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    return reproject(df, lon, lat, 4326, suggest_metric_crs(*map(float, box)))


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark, out = get_session(f"lattis-{args.workflow}"), ensure_dir(args.out or export_dir(args.workflow))
    stats = {"hydrology": hydrology, "oceanography": oceanography, "airspace": airspace, "maritime": maritime}[args.workflow](spark, args, out)
    with open(os.path.join(out, "summary.json"), "w") as f:
        json.dump(stats, f, indent=1)
    get_logger().info("%s: %s", args.workflow, stats)
    return stats


def hydrology(spark, args, out: str) -> dict:
    from .plans import watershed
    from .sources.geo import read_raster

    w = watershed.run_watershed([read_raster(spark, t) for t in args.tiles], (args.x, args.y), n_lines=args.lines)
    watershed.export(w, out)
    return w.stats


def oceanography(spark, args, out: str) -> dict:
    from .operators.seasonal import long_from_wide
    from .plans import covariates
    from .sources.tabular import read_grid_csvs

    wide = read_grid_csvs(spark, [f for a in args.files for f in sorted(glob.glob(a))], "chlor_")
    long = _metric(long_from_wide(wide, ["longitude", "latitude"]))
    c = covariates.build_covariates(long, args.radius)
    covariates.export(c, covariates.screen(c, args.attribute or ["total_mean"], args.method, permutations=args.permutations), out)
    return {"cells": c.table.count(), "covariates": len(c.columns)}


def airspace(spark, args, out: str) -> dict:
    from .operators.proximity import ProximityConfig
    from .plans.airspace import run_airspace
    from .sources.tabular import read_points

    p = read_points(spark, args.positions, "LONGITUDE", "LATITUDE")
    p = _metric(p.withColumnsRenamed({"x": "lon", "y": "lat"}), "lon", "lat").withColumn("ts", F.col("DATETIME_UTC").cast("timestamp_ntz"))
    p = p.select(
        F.xxhash64("FLIGHT_UID", "ts", "lon", "lat", "ALTITUDE_AGL_FT").alias("pos_id"), F.col("FLIGHT_UID").alias("track"), "ts", epoch_seconds("ts").alias("t"),
        F.col("ALTITUDE_AGL_FT").alias("alt"), F.col("GROUND_SPEED_KNTS").alias("speed"), "x", "y",
    )
    r = run_airspace(p, config=ProximityConfig(horizontal=args.horizontal) if args.horizontal else ProximityConfig(), minutes=args.minutes)
    for name, df in (("cells", r.cells), ("profile", r.profile)):
        df.write.mode("overwrite").csv(f"file://{os.path.abspath(out)}/{name}.csv", header=True)
    s = r.positions.agg(F.count("*").alias("reports"), F.sum("event_count").alias("events")).first()
    return {"reports": s.reports, "events": s.events or 0}


def maritime(spark, args, out: str) -> dict:
    from .operators.learning import REGRESSORS
    from .plans import voyage

    df = spark.read.parquet(args.telemetry) if args.telemetry.rstrip("/").endswith((".parquet", ".pq")) else spark.read.csv(args.telemetry, header=True, inferSchema=True)
    v = voyage.run_voyage(df, args.target, args.time, models=tuple(args.model) or tuple(REGRESSORS), n_iter=args.iterations)
    voyage.export(v, out)
    return v.stats


if __name__ == "__main__":
    main()
