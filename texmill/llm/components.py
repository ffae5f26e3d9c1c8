"""Connected components of links between ids, as joins and aggregates on a checkpointed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from texmill.storage import stash


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links(a, b): component is the least id that can be reached.

    Alternates large stars (each neighbour above a vertex goes to the vertex's least neighbour) and small stars (each
    neighbour below does), which end in one star for each component after O(log**2) rounds. Every round's edges are
    written to the shared folder. Self links only name their id.
    """
    ids = links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    edges = stash(ids)
    named = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    edges = edges.filter("u <> v")
    before = None
    while True:
        edges = stash(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return named.join(edges.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    moved = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
