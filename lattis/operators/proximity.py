"""Space-time proximity joins between moving objects, exposure and rates."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Candidates that a task compares at a time.
_AT_ONCE = 1 << 18

# tasks bring this module's code along, so these operators also run where the package isn't shipped to the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ProximityConfig:
    """Metres, altitude units and seconds; all bounds are inclusive."""

    horizontal: float = 304.8
    vertical: float = 200.0
    seconds: float = 5.0
    #: reports that a group of whole time buckets holds; single buckets with more are also cut in space
    dense: int = 10_000


def _grouped(pos: DataFrame, c: ProximityConfig, cells: str) -> DataFrame:
    """Reports dealt into groups, sorted by group: a report is its own group's, and a guest where an earlier one may be near.

    A group is a number of time buckets of the bound's size, so guests are the few reports of its last bucket's reach; in space
    it is a tile of four bounds a side. Reports with a null or not finite number pair with nothing and are left out.
    """
    s, h = max(c.seconds, 1e-9), max(c.horizontal, 1e-9)
    finite = " and ".join(f"abs({k}) < double('inf')" for k in ("t", "x", "y", "alt"))
    p = pos.select("pos_id", "track", *[F.col(k).cast("double").alias(k) for k in ("t", "x", "y", "alt")]).where(f"pos_id is not null and {finite}")
    most = p.groupBy(F.floor(F.col("t") / s).alias("b")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if cells == "auto":
        cells = "space_time" if most > c.dense else "time"
    dims = [("gt", "t", s, 0.0, s * max(1, c.dense // most))]
    if cells == "space_time":
        dims += [("gx", "x", h, h, 4 * h), ("gy", "y", h, h, 4 * h)]
    own = F.lit(True)
    for name, k, back, ahead, side in dims:
        v, slack = F.col(k), (F.abs(F.col(k)) + back) * 1e-14
        p = p.withColumn(name, F.explode(F.sequence(F.floor((v - back - slack) / side), F.floor((v + ahead + (slack if ahead else 0)) / side))))
        own &= F.col(name) == F.floor(v / side)
    at = [name for name, *_ in dims]
    # the work is in the pairs, not in the rows by which small partitions are put together
    n = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * p.sparkSession.sparkContext.defaultParallelism)
    p = p.select(F.struct(*at).cast("string").alias("at"), own.alias("own"), "pos_id", "track", "t", "x", "y", "alt")
    return p.repartition(n, "at").sortWithinPartitions("at")


@dataclass
class _Group:
    """The reports of a group by time, then by rank, the order of their pos_id."""

    ids: pa.Array
    rank: np.ndarray
    track: np.ndarray
    own: np.ndarray
    t: np.ndarray
    x: np.ndarray
    y: np.ndarray
    alt: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Group:
        col = {k: rows[k].combine_chunks() for k in rows.column_names}
        rank = np.unique(col["pos_id"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((rank, col["t"].to_numpy()))
        track = col["track"].dictionary_encode(null_encoding="encode").indices.to_numpy()
        rest = (rank, track, col["own"].to_numpy(zero_copy_only=False), *[col[k].to_numpy() for k in ("t", "x", "y", "alt")])
        return cls(col["pos_id"].take(pa.array(order)), *[v[order] for v in rest])

    def pairs(self, c: ProximityConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the earlier and the later report, and their distance: all pairs whose earlier report is the group's own."""
        n, h = len(self.t), max(c.horizontal, 1e-9) * (1 + 1e-9)
        side = max(h, np.ptp(self.x) / 1e6, np.ptp(self.y) / 1e6)
        cx, cy = (np.floor(v / side) for v in (self.x, self.y))
        cx, cy = ((v - v.min()).astype(np.int64) + 1 for v in (cx, cy))
        wide = int(cy.max()) + 2
        code = cx * wide + cy
        there, cell = np.unique(code, return_inverse=True)
        key = cell * (n + 1) + np.arange(n)
        by_cell = np.argsort(key)
        key, x, y = key[by_cell], self.x[by_cell], self.y[by_cell]
        mine = np.flatnonzero(self.own)
        end = np.searchsorted(self.t, self.t[mine] + c.seconds + (np.abs(self.t[mine]) + c.seconds) * 1e-14, "right")
        for step in (dx * wide + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            k = np.minimum(np.searchsorted(there, code[mine] + step), len(there) - 1)
            some = there[k] == code[mine] + step
            a, base = mine[some], k[some] * (n + 1)
            lo = np.searchsorted(key, base + a + 1)
            m = np.searchsorted(key, base + end[some]) - lo
            total = np.cumsum(m)
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _AT_ONCE, "right")))
                part = m[at:to]
                i = np.repeat(a[at:to], part)
                j = np.arange(len(i)) + np.repeat(lo[at:to] - (np.cumsum(part) - part), part)
                dx, dy = self.x[i] - x[j], self.y[i] - y[j]
                near = np.flatnonzero(dx * dx + dy * dy <= h * h)
                i, j, d = i[near], by_cell[j[near]], np.hypot(dx[near], dy[near])
                ok = (d <= c.horizontal) & (np.abs(self.alt[i] - self.alt[j]) <= c.vertical) & (self.t[j] - self.t[i] <= c.seconds) & (self.track[i] != self.track[j]) & (self.rank[i] != self.rank[j])
                yield i[ok], j[ok], d[ok]
                at = to


def _run(pos: DataFrame, c: ProximityConfig, cells: str, what: Callable[[_Group], Iterator[list]], schema: StructType) -> DataFrame:
    """Rows of schema that what makes of each group."""

    def each(batches):
        held, now = [], None
        for b in batches:
            at = b.column("at").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi and at[lo] != now:
                    yield held
                    held, now = [], at[lo]
                held.append(b.slice(lo, hi - lo))
        yield held

    def run(batches):
        for held in each(batches):
            if held:
                for columns in what(_Group.of(pa.Table.from_batches(held))):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema.names)

    return _grouped(pos, c, cells).mapInArrow(run, schema)


def _pairs(pos: DataFrame, config: ProximityConfig, cells: str) -> DataFrame:
    """proximity_pairs with the earlier time as t0."""

    def what(g: _Group):
        for a, b, d in g.pairs(config):
            first = g.rank[a] < g.rank[b]
            yield [g.ids.take(pa.array(np.where(first, a, b))), g.ids.take(pa.array(np.where(first, b, a))), d, g.t[b] - g.t[a], g.t[a]]

    id_type = pos.schema["pos_id"].dataType
    schema = StructType().add("i", id_type).add("j", id_type).add("distance_m", "double").add("dt_s", "double").add("t0", "double")
    return _run(pos, config, cells, what, schema)


def proximity_pairs(pos: DataFrame, config: ProximityConfig = ProximityConfig(), cells: str = "auto") -> DataFrame:
    """Pairs (i < j) of reports of different tracks within all three bounds: i, j, distance_m, dt_s.

    pos has pos_id, track, t (seconds), x, y, alt. Reports are dealt into groups of time buckets ("time"), or of time buckets and
    tiles ("space_time"; "auto" where a time bucket holds many reports); a few are guests of a second group. A group finds its
    pairs on a grid of the bound's size, in arrays. A null altitude pairs with nothing; two null tracks count as one track.
    """
    return _pairs(pos, config, cells).drop("t0")


def proximity_counts(pos: DataFrame, config: ProximityConfig = ProximityConfig(), pairs: DataFrame | None = None) -> DataFrame:
    """pos with event_count: the pairs that each report is in. Without pairs the groups count theirs, and no pair leaves them."""
    if pairs is None:

        def what(g: _Group):
            n = sum((np.bincount(np.concatenate((a, b)), minlength=len(g.t)) for a, b, _ in g.pairs(config)), np.zeros(len(g.t), np.int64))
            some = np.flatnonzero(n)
            yield [g.ids.take(pa.array(some)), n[some].astype(np.int64)]

        each = _run(pos, config, "auto", what, StructType().add("c_id", pos.schema["pos_id"].dataType).add("n", "long"))
        n = each.groupBy("c_id").agg(F.sum("n").alias("event_count"))
    else:
        n = pairs.select(F.explode(F.array("i", "j")).alias("c_id")).groupBy("c_id").agg(F.count("*").alias("event_count"))
    # what is planned from the size of pos's files may be far off
    return pos.join(n.hint("merge"), F.col("pos_id") == F.col("c_id"), "left").drop("c_id").withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("long")))


def windowed_pairs(pos: DataFrame, config: ProximityConfig, window_s: float) -> DataFrame:
    """Pairs with the tumbling window (from the earliest report) that owns them: the one with the earlier time."""
    start = pos.agg(F.min("t")).first()[0] or 0.0
    return _pairs(pos, config, "auto").withColumn("window_id", F.floor((F.col("t0") - start) / window_s)).drop("t0")


def window_counts(pos: DataFrame, config: ProximityConfig, window_s: float) -> DataFrame:
    """(window_id, pairs): the pairs of each window of windowed_pairs, counted within the groups."""
    start = float(pos.agg(F.min("t")).first()[0] or 0.0)

    def what(g: _Group):
        w = np.floor((g.t - start) / window_s).astype(np.int64)
        n = sum((np.bincount(a, minlength=len(w)) for a, _, _ in g.pairs(config)), np.zeros(len(w), np.int64))
        ids, at = np.unique(w, return_inverse=True)
        n = np.bincount(at, n, len(ids)).astype(np.int64)
        yield [ids[n > 0], n[n > 0]]

    each = _run(pos, config, "auto", what, StructType().add("window_id", "long").add("n", "long"))
    return each.groupBy("window_id").agg(F.sum("n").alias("pairs"))


def _gaps(df: DataFrame, track: str, t: str) -> DataFrame:
    return df.where(F.col(track).isNotNull()).withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(track).orderBy(t)))


def exposure_hours(df: DataFrame, t: str = "t", track: str | None = "track", max_gap_s: float = 600) -> DataFrame:
    """One row: hours observed. Without a track the whole span; else the gaps within tracks of up to max_gap_s."""
    if track is None:
        return df.agg(((F.max(t) - F.min(t)) / 3600).alias("hours"))
    return _gaps(df, track, t).where(F.col("gap") <= max_gap_s).agg((F.coalesce(F.sum("gap"), F.lit(0.0)) / 3600).alias("hours"))


def median_report_interval(df: DataFrame, t: str = "t", track: str = "track") -> DataFrame:
    """One row: the exact median gap within tracks, at least 1 s; 1 without gaps."""
    return _gaps(df, track, t).agg(F.greatest(F.lit(1.0), F.coalesce(F.median("gap"), F.lit(1.0))).alias("seconds"))


def flag_unacceptable(count: Column, exposure_hours_total: Column, max_rate: float = 1e-4) -> Column:
    return (count > 0) & (count / F.greatest(exposure_hours_total, F.lit(1e-9)) > max_rate)
