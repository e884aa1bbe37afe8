"""Connected components by contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node reachable.

    Each round points every node at its neighbour (or itself) of lowest hashed priority and contracts the edges; with hashed
    priorities a constant share of the nodes goes per round, so the rounds grow with the logarithm of the longest chain. Every
    round is written to the shared folder. Nothing but a row count comes to the driver. No edges: no rows.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    whole, found, turn = edges, None, 0
    while edges.take(1):
        rank = lambda c, salt=turn: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), c.alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        step = written(best.select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a")))["v"].alias("up")), "cc-step")
        a, b = step.toDF("a", "up_a"), step.toDF("b", "up_b")
        edges = written(edges.join(a, "a").join(b, "b").where("up_a <> up_b").select(
            F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct(), "cc-edges")
        if found is None:
            found = step.toDF("node", "root")
        else:
            nxt = step.toDF("root", "up")
            found = found.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        found, turn = written(found, "cc-found"), turn + 1
    if found is None:
        return whole.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
