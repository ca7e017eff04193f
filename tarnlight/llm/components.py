"""Connected components of an edge table, by alternating large-star and small-star rounds.

Only DataFrame operations; each round is written to the shared folder, which cuts the lineage. What reaches
the driver in a round is one count and one checksum, and a round's tables are deleted when the next is written. The minima are combined before any shuffle, and in the
large-star's join the nodes with very many edges are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Salts, discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (the smallest node) for every node with an edge to another; nulls and loops are ignored."""
    a, b = F.col(u), F.col(v)
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lowest")
        salts = Salts(lowest, "u")
        large = salts.left(both.where("v > u"), ["v"]).join(salts.right(lowest.select("u", "m")), ["u", "__salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        read, now, before = (now, lowest), materialise(small, "edges"), state
        for table in read:
            discard(table)
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
