"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped ``min`` (combined before its shuffle) and a join whose
hot side AQE may split; nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # edges point from the larger to the smaller node
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(down)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; the component is its smallest node.

    Self loops and repeated edges are allowed; nulls are ignored.
    """
    work = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    work, seen = materialize(work, "edges"), None
    for _ in range(max_rounds):
        state = work.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        work = materialize(_small_star(_large_star(work)).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    # at the fixed point every edge leads from a node to its component's smallest node
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
