"""Airspace: reports -> proximity events -> hexagons -> rates and tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import HexLattice, hex_radius_from_travel_time
from ..operators import inference, proximity
from ..operators.cells import points_to_cells
from ..runtime import stored


@dataclass(frozen=True)
class AirspaceFilter:
    """hours are half open, the other bounds inclusive; None skips a filter. bbox: x0, y0, x1, y1."""

    hours: tuple[int, int] | None = (7, 19)
    altitude: tuple[float, float] | None = (0, 500)
    min_speed: float | None = None
    bbox: tuple[float, float, float, float] | None = None


@dataclass
class AirspaceResult:
    positions: DataFrame
    cells: DataFrame
    profile: DataFrame
    lattice: HexLattice


def filter_positions(pos: DataFrame, f: AirspaceFilter) -> DataFrame:
    if f.hours:
        pos = pos.where((F.hour("ts") >= f.hours[0]) & (F.hour("ts") < f.hours[1]))
    if f.altitude:
        pos = pos.where(F.col("alt").between(*f.altitude))
    if f.min_speed is not None:
        pos = pos.where(F.col("speed") >= f.min_speed)
    if f.bbox:
        pos = pos.where(F.col("x").between(f.bbox[0], f.bbox[2]) & F.col("y").between(f.bbox[1], f.bbox[3]))
    return pos


def flight_time_lattice(pos: DataFrame, minutes: float = 5, speed_kn: float | None = None, divisor: float = 2) -> HexLattice:
    speed = speed_kn if speed_kn is not None else pos.agg(F.median("speed")).first()[0]
    return HexLattice.for_points(pos, radius=hex_radius_from_travel_time(speed, minutes, "knots", divisor))


def summarise_cells(counted: DataFrame, lattice: HexLattice, k: int = 3, scheme: str = "natural_breaks") -> DataFrame:
    """Every cell with its reports, events, events per 1,000 reports (null if empty) and risk class."""
    c = points_to_cells(counted, lattice, {"event_count": "sum"})
    c = c.withColumn("event_count", F.coalesce(F.col("event_count").cast("long"), F.lit(0).cast("long")))
    c = c.withColumn("events_per_1k_reports", F.when(F.col("n_points") > 0, 1000 * F.col("event_count") / F.col("n_points")))
    # the class bounds read the cells first; without a stored copy all pairs would be found again
    return inference.risk_levels(stored(c), "event_count", k, scheme)


def hourly_profile(counted: DataFrame) -> DataFrame:
    p = counted.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("reports"), F.sum("event_count").alias("events"), F.count_distinct("track").alias("tracks"))
    return p.withColumn("events_per_1k_reports", 1000 * F.col("events") / F.col("reports"))


def test_cells(cells: DataFrame, pos: DataFrame, max_rate: float = 1e-4, interval_s: float | None = None) -> DataFrame:
    """Cells with excess and rate tests; empty cells stay untested (null)."""
    interval = interval_s if interval_s is not None else proximity.median_report_interval(pos).first()[0]
    full = cells.where("n_points > 0").withColumn("exposure_h", F.col("n_points") * interval / 3600)
    ex = inference.poisson_excess(full, "event_count").select("hex_id", F.col("p_adjusted").alias("excess_p"), F.col("significant").alias("excess"))
    ra = inference.poisson_rate(full, "event_count", "exposure_h", max_rate).select("hex_id", F.col("p_adjusted").alias("rate_p"), F.col("significant").alias("over_rate"))
    return cells.join(ex, "hex_id", "left").join(ra, "hex_id", "left")


test_cells.__test__ = False


def hour_risk_dependence(counted: DataFrame, cells: DataFrame, lattice: HexLattice):
    """Chi-square of risk label by hour on events; None with fewer than two labels or hours."""
    p = lattice.place(counted.where("event_count > 0")).withColumns({"hour": F.hour("ts"), "hex_id": F.coalesce("hex_id", F.lit(-1).cast("long"))})
    p = p.join(cells.select("hex_id", "risk_label"), "hex_id")
    try:
        return inference.chi_square(p, "risk_label", "hour", "event_count")
    except ValueError:
        return None


def run_airspace(pos: DataFrame, keep: AirspaceFilter = AirspaceFilter(), config: proximity.ProximityConfig = proximity.ProximityConfig(), radius: float | None = None, minutes: float = 5, k: int = 3, scheme: str = "natural_breaks", max_rate: float | None = None) -> AirspaceResult:
    pos = filter_positions(pos, keep)
    counted = proximity.proximity_counts(pos, config)
    lattice = HexLattice.for_points(pos, radius=radius) if radius else flight_time_lattice(pos, minutes)
    cells = summarise_cells(counted, lattice, k, scheme)
    if max_rate is not None:
        cells = test_cells(cells, pos, max_rate)
    return AirspaceResult(counted, cells, hourly_profile(counted), lattice)
