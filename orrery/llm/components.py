"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """Edges (u, v), longs, each link once or more, to (u, v): v is the least node that u reaches.

    Nodes without a link to another node have no row.  Every step is an aggregation and an
    equi-join with what it gave.  That is written first, so that the join is one of two plain
    exchanges, which Spark splits where one node has very many links.  Each step's tables are
    written to the shared folder and its predecessor's deleted.
    """
    now = scratch.save(edges.where("u <> v").select("u", "v").distinct(), f"{name}-0")
    seen, i = None, 0
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == seen:
            return now
        seen, i = (found["n"], found["h"]), i + 1
        large = scratch.save(_large_star(now, scratch, f"{name}-least").distinct(), f"{name}-large")
        after = scratch.save(_small_star(large, scratch, f"{name}-lesser").distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}", f"{name}-least", f"{name}-large", f"{name}-lesser")
        now = after
