"""Styled map bundles: a GeoPackage, GeoTIFFs, a style a layer, a manifest and a script that loads them."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inference import class_bounds
from ..operators.raster import Raster
from .geo import write_gpkg, write_raster

#: The end colours of the ramps.
LOW, HIGH = (255, 255, 204), (37, 52, 148)


def ramp(n: int) -> list[tuple[int, int, int]]:
    """n colours, evenly from LOW to HIGH."""
    return [tuple(round(a + (b - a) * i / max(n - 1, 1)) for a, b in zip(LOW, HIGH, strict=True)) for i in range(n)]


def _document(*children: ET.Element) -> str:
    root = ET.Element("qgis", version="3.28", styleCategories="Symbology")
    root.extend(children)
    return ET.tostring(root, encoding="unicode")


def _symbols(colors: list[tuple[int, int, int]]) -> ET.Element:
    out = ET.Element("symbols")
    for i, c in enumerate(colors):
        layer = ET.SubElement(ET.SubElement(out, "symbol", type="marker", name=str(i), alpha="1"), "layer", {"class": "SimpleMarker", "enabled": "1"})
        opts = ET.SubElement(layer, "Option", type="Map")
        for k, v in (("color", ",".join(map(str, (*c, 255)))), ("outline_style", "no"), ("size", "2.4")):
            ET.SubElement(opts, "Option", type="QString", name=k, value=v)
    return out


def graduated_style(column: str, bounds: list[float], low: float) -> str:
    """Classes up to each bound; the first begins at low."""
    r = ET.Element("renderer-v2", type="graduatedSymbol", attr=column, graduatedMethod="GraduatedColor")
    ranges = ET.SubElement(r, "ranges")
    for i, (a, b) in enumerate(zip([low, *bounds], bounds, strict=False)):
        ET.SubElement(ranges, "range", lower=repr(a), upper=repr(b), symbol=str(i), label=f"{a:.2f} - {b:.2f}", render="true")
    r.append(_symbols(ramp(len(bounds))))
    return _document(r)


def categorized_style(column: str, values: list[str]) -> str:
    r = ET.Element("renderer-v2", type="categorizedSymbol", attr=column)
    cats = ET.SubElement(r, "categories")
    for i, v in enumerate(values):
        ET.SubElement(cats, "category", value=v, symbol=str(i), label=v, render="true")
    r.append(_symbols(ramp(len(values))))
    return _document(r)


def single_style() -> str:
    r = ET.Element("renderer-v2", type="singleSymbol")
    r.append(_symbols([HIGH]))
    return _document(r)


def raster_style(low: float, high: float, classes: int = 5, discrete: bool = False) -> str:
    """A pseudocolour band with evenly spaced stops."""
    pipe = ET.Element("pipe")
    r = ET.SubElement(pipe, "rasterrenderer", type="singlebandpseudocolor", band="1", opacity="1", classificationMin=repr(low), classificationMax=repr(high))
    shader = ET.SubElement(ET.SubElement(r, "rastershader"), "colorrampshader", colorRampType="DISCRETE" if discrete else "INTERPOLATED", minimumValue=repr(low), maximumValue=repr(high))
    for i, c in enumerate(ramp(classes)):
        v = low + (high - low) * i / max(classes - 1, 1)
        ET.SubElement(shader, "item", value=repr(v), label=f"{v:.3g}", color="#%02x%02x%02x" % c, alpha="255")
    return _document(pipe)


_LOADER = '''"""Run this in the Python console of QGIS 3: it loads the layers that manifest.json beside it names, with their styles."""
import json
import os

from qgis.core import QgsProject, QgsRasterLayer, QgsVectorLayer

here = os.path.dirname(os.path.abspath(__file__))
with open(os.path.join(here, "manifest.json")) as f:
    layers = json.load(f)["layers"]
for one in layers:
    path = os.path.join(here, one["path"])
    layer = QgsRasterLayer(path, one["name"]) if one["kind"] == "raster" else QgsVectorLayer(path + "|layername=" + one["name"], one["name"], "ogr")
    if not layer.isValid():
        print("cannot load", one["name"])
        continue
    layer.loadNamedStyle(os.path.join(here, one["style"]))
    QgsProject.instance().addMapLayer(layer)
'''


@dataclass
class QgisBundle:
    """Layers are gathered, then write() makes the folder. Map layers are export-sized: points stream through the driver."""

    folder: str
    name: str = "lattis"
    points: list[tuple] = field(default_factory=list)
    rasters: list[tuple] = field(default_factory=list)

    def add_points(self, df: DataFrame, layer: str, graduated: str | None = None, categorized: str | None = None, k: int = 5, scheme: str = "natural_breaks", srs: int = 4326) -> QgisBundle:
        """A point layer (x, y). An empty one is skipped."""
        for c in (graduated, categorized):
            if c is not None and c not in df.columns:
                raise KeyError(c)
        if df.take(1):
            self.points.append((df, layer, graduated, categorized, k, scheme, srs))
        return self

    def add_raster(self, r: Raster, layer: str, discrete: bool = False) -> QgisBundle:
        self.rasters.append((r, layer, discrete))
        return self

    def write(self) -> dict:
        os.makedirs(os.path.join(self.folder, "styles"), exist_ok=True)
        layers, file = [], f"{self.name}.gpkg"
        if os.path.exists(os.path.join(self.folder, file)):
            os.remove(os.path.join(self.folder, file))
        for df, layer, graduated, categorized, k, scheme, srs in self.points:
            flat = df.select(*[c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))])
            write_gpkg(flat, os.path.join(self.folder, file), layer, srs=srs)
            if graduated and (low := df.agg(F.min(F.col(graduated).cast("double"))).first()[0]) is not None:
                style = graduated_style(graduated, [float(b) for b in class_bounds(df.where(F.col(graduated).isNotNull()), graduated, k, scheme)], low)
            elif categorized:
                style = categorized_style(categorized, [r[0] for r in df.where(F.col(categorized).isNotNull()).groupBy(F.col(categorized).cast("string").alias("v")).count().orderBy("v").collect()])  # a row a class
            else:
                style = single_style()
            layers.append(self._layer("vector", layer, file, style))
        for r, layer, discrete in self.rasters:
            write_raster(r, os.path.join(self.folder, f"{layer}.tif"))
            z = r.valid().agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
            layers.append(self._layer("raster", layer, f"{layer}.tif", raster_style(float(z.lo or 0), float(z.hi if z.hi is not None else 1), discrete=discrete)))
        manifest = {"name": self.name, "layers": layers}
        for path, text in (("manifest.json", json.dumps(manifest, indent=1)), ("load_layers.py", _LOADER)):
            with open(os.path.join(self.folder, path), "w") as f:
                f.write(text)
        return manifest

    def _layer(self, kind: str, layer: str, path: str, style: str) -> dict:
        at = os.path.join("styles", f"{layer}.qml")
        with open(os.path.join(self.folder, at), "w") as f:
            f.write(style)
        return {"kind": kind, "name": layer, "path": path, "style": at}
