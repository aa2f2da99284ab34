"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.llm.common import materialize, tasks_for


def connected_components(edges: DataFrame, rounds: int = 50, tasks: int | None = None) -> DataFrame:
    """(node, component) from edges (a, b) of 64-bit ids: the smallest id reachable, for every id in an edge.

    Each step is one partial aggregation (the smallest neighbour) and one join; the state is a written
    table, and only two numbers per round, a count and a checksum, come to the driver.  ``tasks`` bounds
    the tasks of the first write, later ones follow the number of edges.  Self-loops and
    repeated edges are harmless; without edges the result is empty.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges", tasks)
    before, tasks = None, tasks_for(edges.count())
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges, tasks), tasks), "cc-edges", tasks)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    # every edge now leads from a component's smallest id
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
