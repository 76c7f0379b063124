"""Kepler map frames and configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colour ramps.
PALETTES = {
    "sequential": ["#ffffcc", "#c7e9b4", "#7fcdbb", "#41b6c4", "#2c7fb8", "#253494"],
    "diverging": ["#2166ac", "#67a9cf", "#d1e5f0", "#fddbc7", "#ef8a62", "#b2182b"],
}


def kepler_available() -> bool:
    try:
        import keplergl  # noqa: F401
    except ImportError:
        return False
    return True


def prepare_frame(df: DataFrame, lon: str = "lon", lat: str = "lat", drop: tuple[str, ...] = (), keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Times as text, booleans and numbers as doubles (columns in keep stay), nested columns left out, rows without a place left out."""
    cols = []
    for c, k in df.drop(*drop).dtypes:
        if c in keep:
            cols.append(F.col(c))
        elif k.startswith(("timestamp", "date")):
            cols.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c))
        elif k in ("boolean", "int", "bigint", "smallint", "tinyint", "float", "double"):
            cols.append((F.col(c).cast("int") if k == "boolean" else F.col(c)).cast("double").alias(c))
        elif k == "string":
            cols.append(F.when(~F.lower(c).isin("nan", "nat", "none"), F.col(c)).alias(c))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(*cols)


def zoom_for_bounds(x0: float, y0: float, x1: float, y1: float) -> float:
    span = max(x1 - x0, y1 - y0, 1e-6)
    return max(1.0, min(18.0, math.log2(360 / span)))


def map_state(df: DataFrame, lon: str = "lon", lat: str = "lat") -> dict:
    x0, y0, x1, y1 = df.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    return {"longitude": (x0 + x1) / 2, "latitude": (y0 + y1) / 2, "zoom": zoom_for_bounds(x0, y0, x1, y1)}


@dataclass
class KeplerMap:
    layers: list[dict] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)
    tooltips: dict[str, list[str]] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    state: dict = field(default_factory=dict)

    def add_layer(self, name: str, df: DataFrame, color: str | None = None, kind: str = "point", time: str | None = None, palette: str = "sequential") -> KeplerMap:
        """Adds a layer; empty frames are skipped. A colour column whose commonest value has over half of the rows is quantised."""
        if not df.take(1):
            return self
        scale = "quantile"
        if color:
            top = df.groupBy(color).count().agg(F.max("count"), F.sum("count")).first()
            scale = "quantize" if top[0] / top[1] > 0.5 else "quantile"
        channels = {"colorField": {"name": color, "type": "real"} if color else None, "colorScale": scale}
        self.layers.append({"id": name, "type": kind, "config": {"dataId": name, "label": name, "columns": {"lat": "lat", "lng": "lon", "altitude": None}, "isVisible": True, "visConfig": {"opacity": 0.8, "colorRange": {"name": palette, "type": palette, "category": "custom", "colors": PALETTES[palette]}}}, "visualChannels": channels})
        if time:
            self.filters.append({"dataId": [name], "id": f"{name}-{time}", "name": [time], "type": "timeRange", "enlarged": True})
        self.tooltips[name] = [c for c in df.columns if c not in ("lon", "lat")][:8]
        self.frames[name] = df
        self.state = self.state or map_state(df)
        return self

    def config(self) -> dict:
        tips = {"fieldsToShow": {k: [{"name": c, "format": None} for c in v] for k, v in self.tooltips.items()}, "enabled": True}
        return {"version": "v1", "config": {"visState": {"filters": self.filters, "layers": self.layers, "interactionConfig": {"tooltip": tips}}, "mapState": self.state, "mapStyle": {"styleType": "dark"}}}

    def save_config(self, path: str) -> None:
        import json

        with open(path, "w") as f:
            json.dump(self.config(), f, indent=1)

    def widget(self):
        if not kepler_available():
            raise ImportError("keplergl isn't installed")
        import keplergl

        return keplergl.KeplerGl(data={k: d.toPandas() for k, d in self.frames.items()}, config=self.config())

    def save_html(self, path: str) -> None:
        self.widget().save_to_html(file_name=path)
