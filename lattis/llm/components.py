"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): for each node of a link, the smallest node it reaches.

    Both steps hang neighbours on the smallest neighbour, so the edges shrink to stars in about log rounds. Minima
    are aggregated before the shuffle and joined back, so no group is gathered, whatever a node's degree. Every
    round is written to the shared folder. Self links and nulls are ignored; no links give no rows.
    """
    e = stored(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as k", "least(u, m) as m")
        # large star: larger neighbours hang on the smallest of the neighbourhood
        big = both.where("v > u").join(low, F.col("u") == F.col("k")).selectExpr("v as u", "m as v").where("u <> v").distinct()
        # small star: smaller neighbours and the node itself hang on the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        new = big.join(low, F.col("u") == F.col("k")).select(F.explode(F.expr("array(struct(u, m), struct(v as u, m))")).alias("x"))
        new = stored(new.selectExpr("x.u as u", "x.m as v").where("u <> v").distinct())
        dropped(e)
        e = new
        sign = tuple(e.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(20, 0))"))).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components have not settled")
    return e.selectExpr("u as node", "v as component").union(e.selectExpr("v as node", "v as component").distinct())
