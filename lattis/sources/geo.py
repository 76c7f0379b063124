"""GeoTIFF, GeoJSON and GeoPackage codecs: readers and writers without GDAL."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import GridSpec, Raster

#: TIFF tags and field types (struct codes).
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
TILE, NODATA = 256, -9999.0


def encode_tiff(data: np.ndarray, grid: GridSpec, compress: str = "deflate") -> bytes:
    """A tiled float32 GeoTIFF; NaN becomes the nodata value."""
    rows, cols = data.shape
    nodata = NODATA if grid.nodata is None or grid.nodata != grid.nodata else grid.nodata
    data = np.where(np.isfinite(data), data, nodata).astype("<f4")
    tiles = []
    for r in range(0, rows, TILE):
        for c in range(0, cols, TILE):
            t = np.full((TILE, TILE), nodata, "<f4")
            part = data[r : r + TILE, c : c + TILE]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(t.tobytes(), 6) if compress == "deflate" else t.tobytes())
    epsg = grid.crs if isinstance(grid.crs, int) else 32767
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg in (4326, 4269) else 1, 1025, 0, 1, 1, 2048 if epsg in (4326, 4269) else 3072, 0, 1, epsg)
    said = f"{nodata:g}\0".encode()
    tags = [
        (256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (32,)), (259, 3, (8 if compress == "deflate" else 1,)), (262, 3, (1,)), (277, 3, (1,)), (322, 4, (TILE,)), (323, 4, (TILE,)),
        (324, 4, (0,) * len(tiles)), (325, 4, tuple(map(len, tiles))), (339, 3, (3,)), (33550, 12, (grid.a, -grid.e, 0.0)), (33922, 12, (0.0, 0.0, 0.0, grid.c, grid.f, 0.0)), (34735, 3, keys), (42113, 2, said),
    ]

    def body(kind, v):
        return v if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)

    extra = 8 + 2 + 12 * len(tags) + 4
    at = extra + sum((len(body(k, v)) + 1) // 2 * 2 for _, k, v in tags if len(body(k, v)) > 4)
    starts = tuple(at + int(x) for x in np.cumsum([0, *map(len, tiles[:-1])]))
    out, tail = [b"II*\0" + struct.pack("<I", 8), struct.pack("<H", len(tags))], b""
    for tag, kind, v in tags:
        v = starts if tag == 324 else v
        b = body(kind, v)
        out.append(struct.pack("<HHI", tag, kind, len(v)) + (b.ljust(4, b"\0") if len(b) <= 4 else struct.pack("<I", extra + len(tail))))
        if len(b) > 4:
            tail += b + b"\0" * (len(b) % 2)
    return b"".join([*out, struct.pack("<I", 0), tail, *tiles])


def tiff_tags(blob: bytes) -> tuple[str, dict[int, tuple]]:
    order = "<" if blob[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", blob, 4)
    (n,) = struct.unpack_from(order + "H", blob, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * k)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size, place = struct.calcsize(code) * count, at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", blob, place)
        tags[tag] = (blob[place : place + count],) if kind == 2 else struct.unpack_from(f"{order}{count}{code}", blob, place)
    return order, tags


def tiff_grid(blob: bytes) -> GridSpec:
    _, t = tiff_tags(blob)
    sx, sy, _ = t.get(33550, (1.0, 1.0, 0.0))
    i, j, _, x, y, _ = t.get(33922, (0.0,) * 6)
    keys = t.get(34735, ())
    crs = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072)), None)
    nodata = float(t[42113][0].rstrip(b"\0 ") or b"nan") if 42113 in t else None
    return GridSpec(t[257][0], t[256][0], sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy, crs, nodata)


def tiff_blocks(blob: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values) of each tile or strip; uncompressed and deflate, one band."""
    order, t = tiff_tags(blob)
    rows, cols, bits, fmt = t[257][0], t[256][0], t[258][0], t.get(339, (1,))[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[fmt] }{bits // 8}")
    tiled = 322 in t
    w, h = (t[322][0], t[323][0]) if tiled else (cols, t.get(278, (rows,))[0])
    across = -(-cols // w)
    for k, (at, n) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True)):
        part = blob[at : at + n]
        if t[259][0] in (8, 32946):
            part = zlib.decompress(part)
        elif t[259][0] != 1:
            raise ValueError(f"unsupported TIFF compression {t[259][0]}")
        r, c = k // across * h, k % across * w
        a = np.frombuffer(part, kind).reshape(-1, w)
        if t.get(317, (1,))[0] == 2:
            a = np.cumsum(a, axis=1, dtype=kind)
        yield r, c, a[: rows - r, : cols - c]


def read_raster(spark: SparkSession, path: str) -> Raster:
    """One band as a cell table; tiles are decoded on executors."""
    files = spark.read.format("binaryFile").load(path)
    grid = tiff_grid(files.select("content").first()[0])

    def run(frames):
        import pandas as pd

        for f in frames:
            for blob in f["content"]:
                for r, c, a in tiff_blocks(blob):
                    rr, cc = np.mgrid[r : r + a.shape[0], c : c + a.shape[1]]
                    yield pd.DataFrame({"row": rr.ravel(), "col": cc.ravel(), "value": a.astype(float).ravel()})

    return Raster(files.select("content").mapInPandas(run, "row long, col long, value double"), grid)


def write_raster(r: Raster, path: str) -> None:
    """A GeoTIFF for export; the cells of one raster reach the driver."""
    data = np.full((r.grid.rows, r.grid.cols), np.nan)
    for x in r.valid().toLocalIterator():
        data[x.row, x.col] = x.value
    with open(path, "wb") as f:
        f.write(encode_tiff(data, r.grid))


def geojson_features(df: DataFrame, geometry: str, coordinates: str, columns: list[str]) -> DataFrame:
    """One feature a row as JSON text; coordinates is a column of nested arrays, geometry their GeoJSON type."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), F.col(coordinates).alias("coordinates")).alias("geometry"), F.struct(*columns).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, geometry: str, coordinates: str, columns: list[str]) -> None:
    """A FeatureCollection, streamed partition by partition."""
    with open(path, "w") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for k, r in enumerate(geojson_features(df, geometry, coordinates, columns).toLocalIterator()):
            f.write(",\n"[not k :] + r.value)
        f.write("]}")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(geometry_type, coordinates as JSON, properties as a map) of each feature."""
    doc = spark.read.text(path, wholetext=True)
    feats = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    return feats.select(F.get_json_object("f", "$.geometry.type").alias("geometry_type"), F.get_json_object("f", "$.geometry.coordinates").alias("coordinates"), F.from_json(F.get_json_object("f", "$.properties"), "map<string, string>").alias("properties"))


def wkb_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def write_gpkg(df: DataFrame, path: str, layer: str, x: str = "x", y: str = "y", srs: int = 4326) -> None:
    """Points of df as a GeoPackage layer."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    cols = [(c, kinds.get(k, "TEXT")) for c, k in df.dtypes if c not in (x, y)]
    with sqlite3.connect(path) as db:
        db.executescript("""PRAGMA application_id = 1196444487;
            CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);
            CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER);
            CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);""")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined')", (f"EPSG:{srs}", srs, srs))
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', ?, 0, 0)", (layer, srs))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, {", ".join(f"{chr(34)}{c}{chr(34)} {k}" for c, k in cols)})')
        head = b"GP\0\1" + struct.pack("<i", srs)
        rows = ((head + wkb_point(r[x], r[y]), *(r[c] if k != "TEXT" or r[c] is None else str(r[c]) for c, k in cols)) for r in df.toLocalIterator())
        db.executemany(f'INSERT INTO "{layer}" (geom, {", ".join(f"{chr(34)}{c}{chr(34)}" for c, _ in cols)}) VALUES ({", ".join("?" * (len(cols) + 1))})', rows)


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A point layer with x and y."""
    with sqlite3.connect(path) as db:
        layer = layer or db.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name").fetchone()[0]
        cur = db.execute(f'SELECT * FROM "{layer}"')
        names = [d[0] for d in cur.description]
        rows = [dict(zip(names, r, strict=True)) for r in cur]
    out = [{**{k: v for k, v in r.items() if k != "geom"}, "x": struct.unpack("<dd", r["geom"][-16:])[0], "y": struct.unpack("<dd", r["geom"][-16:])[1]} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in out], list(out[0])) if out else spark.createDataFrame([], "fid long, x double, y double")
