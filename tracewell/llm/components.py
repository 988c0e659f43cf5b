"""Connected components by alternating large and small stars, all in tables.

Each round rewires every vertex's larger (then smaller) neighbours to its least
neighbour, which keeps components and shortens paths; a round is a partial-then-final
minimum per vertex and a join, so a vertex with very many neighbours is an ordinary
skewed join.  Rounds are written to the shared folder and their predecessors deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """For each vertex of an edge: id, component (the least id reachable). Loops and repeated edges change nothing."""
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = written(pairs, "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours of a vertex, those v > u, move to its least neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "small")
        drop(now)
        drop(large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
