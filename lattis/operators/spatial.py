"""Spatial weights and local statistics on edge tables (i, j, w)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

#: Values that the permutation kernels hold in each worker at most.
MOST_PERMUTED = 4_000_000


def _dealt(points: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Points in buckets of half the reach, once as i and once as j of all 25 buckets about. The number of partitions is
    given: the work is in the pairs, not in the rows by which small partitions are put together."""
    spark, side = points.sparkSession, reach * (0.5 + 1e-9)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    p = points.withColumns({"bx": F.floor(F.col("x") / side), "by": F.floor(F.col("y") / side)})
    around = F.explode(F.array(*[F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by")) for dx in range(-2, 3) for dy in range(-2, 3)]))
    b = p.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), around.alias("at")).select("j", "xj", "yj", F.col("at.bx").alias("ox"), F.col("at.by").alias("oy"))
    return p.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), "bx", "by"), b.repartition(n, "ox", "oy")


def _near(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """a's columns with j and d, for the pairs within reach; never by a broadcast, since b's size is a multiple of what its table's size tells."""
    p = a.join(b.hint("merge"), (F.col("bx") == F.col("ox")) & (F.col("by") == F.col("oy")) & (F.col("i") != F.col("j")))
    d = F.sqrt((F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj")))
    return p.withColumn("d", d).where(F.col("d") <= reach)


def knn(points: DataFrame, k: int = 8) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each point (id, x, y), ties by id.

    A point whose k-th neighbour within the ring of buckets is no farther than a bucket's side is settled; the others go on
    with sides doubled, against all points.
    """
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    k = min(k, n - 1)
    span = max((x1 - x0), (y1 - y0), 1e-9) if n else 1.0
    side, out, left = span / max(1.0, math.sqrt(n / (k + 1))), None, points
    while k > 0:
        d = _near_of(left, points, side)
        ranked = d.withColumn("rank", F.expr("row_number() over (partition by i order by d, j)")).where(F.col("rank") <= k)
        ranked = stored(ranked.withColumn("far", F.expr("max(d) over (partition by i)")).withColumn("m", F.expr("count(*) over (partition by i)")))
        done = ranked.where((F.col("m") == k) & ((F.col("far") <= side) | F.lit(side > span))).select("i", "j", "d", "rank")
        out = done if out is None else out.union(done)
        left = stored(left.join(done.select(F.col("i").alias("id")).distinct(), "id", "left_anti"))
        if not left.take(1):
            break
        side *= 2
    return out if out is not None else points.sparkSession.createDataFrame([], "i long, j long, d double, rank int")


def _near_of(some: DataFrame, every: DataFrame, side: float) -> DataFrame:
    a = some.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    a = a.withColumn("ox", F.explode(F.expr("array(cx - 1, cx, cx + 1)"))).withColumn("oy", F.explode(F.expr("array(cy - 1, cy, cy + 1)")))
    b = every.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))
    p = a.join(b, (F.col("bx") == F.col("ox")) & (F.col("by") == F.col("oy")) & (F.col("i") != F.col("j")))
    return p.select("i", "j", F.sqrt((F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))).alias("d"))


def threshold_distance(points: DataFrame) -> float:
    """The largest nearest-neighbour distance; for under three points the largest distance, or 1."""
    return knn(points, 1).agg(F.max("d")).first()[0] or 1.0


def row_standardise(edges: DataFrame) -> DataFrame:
    s = edges.groupBy("i").agg(F.sum("w").alias("s"))
    return edges.join(s, "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))


def distance_band(points: DataFrame, threshold: float | None = None, multiplier: float = 1.0, alpha: float = -1.5, binary: bool = False, standardise: bool = True) -> DataFrame:
    """Neighbours up to threshold * multiplier, weighted by distance^alpha or 1.

    The edges are far more than the points, so they are found twice, for the sums and for the weights, and never shuffled.
    """
    reach = (threshold if threshold is not None else threshold_distance(points)) * multiplier
    w = F.lit(1.0) if binary else F.pow(F.col("d"), F.lit(alpha))
    a, b = _dealt(points, max(reach, 1e-9))
    if not standardise:
        return _near(a, b, reach).select("i", "j", w.alias("w"))
    s = _near(a, b, reach).groupBy("i").agg(F.sum(w).alias("s"))
    a = a.join(s, "i")
    return _near(a, b, reach).select("i", "j", (w / F.col("s")).alias("w"))


def knn_weights(points: DataFrame, k: int = 8, standardise: bool = True) -> DataFrame:
    e = knn(points, k).select("i", "j", F.lit(1.0).alias("w"))
    return row_standardise(e) if standardise else e


def getis_ord(values: DataFrame, edges: DataFrame, star: bool = True) -> DataFrame:
    """values (id, x) -> (id, gi_z): Ord and Getis 1995; with star a cell counts itself by the largest of its weights."""
    v = values.where("x is not null")
    e = edges.join(v.select(F.col("id").alias("i")), "i", "left_semi").join(v.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j")
    if star:
        own = edges.groupBy("i").agg(F.max("w").alias("w")).join(v.select(F.col("id").alias("i"), F.col("x").alias("xj")), "i")
        e = e.select("i", "w", "xj").unionByName(own.select("i", "w", "xj"))
    s = e.groupBy("i").agg(F.sum(F.col("w") * F.col("xj")).alias("wx"), F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    t = v.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = (F.col("wx") - F.col("m") * F.col("ws")) / (F.col("sd") * F.sqrt((F.col("n") * F.col("w2") - F.col("ws") * F.col("ws")) / (F.col("n") - 1)))
    return s.crossJoin(F.broadcast(t)).select(F.col("i").alias("id"), z.alias("gi_z"))  # t is one row


def classify_z(z: Column) -> Column:
    out = F.lit("not significant")
    for cut, name in ((1.645, "90%"), (1.96, "95%"), (2.576, "99%")):
        out = F.when(z >= cut, f"hot {name}").when(z <= -cut, f"cold {name}").otherwise(out)
    return F.when(z.isNull(), "no data").otherwise(out)


def local_moran(values: DataFrame, edges: DataFrame) -> DataFrame:
    """values (id, x) -> (id, z, lag, lisa_i, quadrant): row-standardised weights; quadrants 1 HH, 2 LH, 3 LL, 4 HL."""
    v = values.where("x is not null")
    t = v.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = v.crossJoin(F.broadcast(t)).select("id", "n", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))
    e = row_standardise(edges.join(z.select(F.col("id").alias("i")), "i", "left_semi").join(z.select(F.col("id").alias("j")), "j", "left_semi"))
    lag = e.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    q = F.expr("case when z > 0 and lag > 0 then 1 when z <= 0 and lag > 0 then 2 when z <= 0 then 3 else 4 end")
    return z.join(lag, "id").select("id", "z", "lag", ((F.col("n") - 1) / F.col("n") * F.col("z") * F.col("lag")).alias("lisa_i"), q.alias("quadrant"))


def permutation_p(values: DataFrame, edges: DataFrame, permutations: int = 999, seed: int = 0) -> DataFrame:
    """(id, p_sim): conditional permutations of the neighbours' weighted sum, folded to the smaller tail.

    Each cell has its own generator from (seed, id), so results don't depend on partitions. Every worker holds all values:
    refused above MOST_PERMUTED cells.
    """
    v = values.where("x is not null")
    n = v.count()
    if n > MOST_PERMUTED:
        raise ValueError(f"{n} cells; permutations hold {MOST_PERMUTED} at most")
    rows = v.orderBy("id").select("id", F.col("x").cast("double").alias("x")).toPandas()
    held = v.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), rows["x"].to_numpy()))
    g = edges.groupBy("i").agg(F.collect_list(F.struct("j", "w")).alias("e"))

    def run(batches):
        ids, x = held.value
        for b in batches:
            out = []
            for i, e in zip(b.column("i").to_pylist(), b.column("e").to_pylist(), strict=True):
                j = np.array([p["j"] for p in e])
                w, at = np.array([p["w"] for p in e]), np.searchsorted(ids, j)
                me = int(np.searchsorted(ids, i))
                ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == j)
                if me >= len(ids) or ids[me] != i or not ok.any():
                    out.append((i, None))
                    continue
                seen, rng, k = float((w[ok] * x[at[ok]]).sum()), np.random.default_rng([seed, i & 0x7FFFFFFF]), int(ok.sum())
                draw = rng.integers(0, len(x) - 1, (permutations, k)) if len(x) > 1 else np.zeros((permutations, k), int)
                sims = (x[np.where(draw >= me, draw + 1, draw)] * w[ok]).sum(axis=1)
                more = int((sims >= seen).sum())
                out.append((i, (min(more, permutations - more) + 1) / (permutations + 1)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([p for _, p in out], pa.float64())], ["id", "p_sim"])

    return g.mapInArrow(run, "id long, p_sim double")


def lisa_clusters(values: DataFrame, edges: DataFrame, permutations: int = 999, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    m = local_moran(values, edges).join(permutation_p(values, row_standardise(edges), permutations, seed), "id", "left")
    names = F.expr("case quadrant when 1 then 'HH' when 2 then 'LH' when 3 then 'LL' else 'HL' end")
    return m.withColumn("lisa_class", F.when(F.col("p_sim") <= alpha, names).otherwise("not significant"))


def hotspots(values: DataFrame, attributes: list[str], edges: DataFrame, method: str = "getis_ord", permutations: int = 999, seed: int = 0) -> DataFrame:
    """values (id and attributes) with z or I, p and class of each attribute; the edge table is shared. Rows null in an attribute
    take no part in its statistics."""
    if method not in ("getis_ord", "local_moran"):
        raise ValueError(f"unknown method {method!r}")
    edges, out = stored(edges), values.select("id")
    for a in attributes:
        v = values.select("id", F.col(a).cast("double").alias("x"))
        if method == "getis_ord":
            s = getis_ord(v, edges).join(permutation_p(v, edges, permutations, seed), "id", "left")
            s = s.select("id", F.col("gi_z").alias(f"{a}_gi_z"), F.col("p_sim").alias(f"{a}_gi_p_sim"))
            out = out.join(s, "id", "left").withColumn(f"{a}_gi_class", classify_z(F.col(f"{a}_gi_z")))
        else:
            s = lisa_clusters(v, edges, permutations, seed=seed)
            out = out.join(s.select("id", *[F.col(c).alias(f"{a}_{n}") for c, n in (("lisa_i", "lisa_i"), ("p_sim", "lisa_p_sim"), ("lisa_class", "lisa_class"))]), "id", "left")
            out = out.withColumn(f"{a}_lisa_class", F.coalesce(f"{a}_lisa_class", F.lit("no data")))
    return out
