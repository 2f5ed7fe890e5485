"""Connected components by alternating large-star and small-star.

Both steps replace the edges of a node by edges to its smallest neighbour: the
large star those to larger neighbours, the small star those to smaller ones.
The smallest neighbour is found by partial aggregation and joined back, so the
neighbours of a node with very many are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common


def _stored_least(least: DataFrame) -> DataFrame:
    """Stored, so that the join back is fed by plain shuffles: adaptive execution splits a node with very many edges."""
    return common.stored(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _stored_least(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _stored_least(down.groupBy("u").agg(F.min("v").alias("m")))
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*").alias("n"), digest.alias("h")).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``links`` (long columns u and v).

    Loops, repeated and reversed links do no harm; null ends are left out.  The
    edges are written to the shared folder after every round, until a round
    changes nothing.
    """
    edges = common.stored(links.select("u", "v").filter("u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = common.stored(_small_star(_large_star(edges)).distinct(), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    # Now every edge leads from a node to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
