"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """node, component for each end of edges (u, v) of integers; component: the smallest node.

    In a round, every node moves to the first of its neighbours and itself, in the order
    of a hash, and edges are drawn anew between the places moved to. Under that order
    chains shrink by a constant factor a round. Empty edges give an empty result; loops
    and repeated edges do no harm.
    """
    work = shared_dir(edges.sparkSession)
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
    live = saved(edges.union(edges.select("v", "u")).distinct(), f"{work}/edges0")
    maps: list[DataFrame] = []
    while True:
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        to = live.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u"))).alias("to"))
        maps.append(saved(to.select(F.col("u").alias("node"), F.col("to.id").alias("to")), f"{work}/map{len(maps)}"))
        m = maps[-1]
        moved = live.join(m.select(F.col("node").alias("u"), F.col("to").alias("x")), "u")
        moved = moved.join(m.select(F.col("node").alias("v"), F.col("to").alias("y")), "v")
        live = saved(moved.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), f"{work}/edges{len(maps)}")
        if live.isEmpty():
            break
    out = maps.pop()
    while maps:
        up = out.select(F.col("node").alias("to"), F.col("to").alias("top"))
        out = saved(maps.pop().join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to")), f"{work}/out{len(maps)}")
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(least, "to").select("node", "component")
