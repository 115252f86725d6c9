"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node that is not the smallest of its component.

    Contraction by rounds: each node hooks to its smallest smaller neighbour,
    parents are shortened by pointer doubling, the edges move to the parents and
    those inside one node vanish.  Parents of a long chain may stay end points of
    edges after they got their row; later rounds move that row and add none.  Aggregates combine before the shuffle and a
    hub's rows meet only joins (which the adaptive skew join splits); each round
    is written, so a lost executor costs one round at most.
    """
    e = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    found = None
    while True:
        p = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        for _ in range(2):
            p = written(p, "parents")
            p = (p.join(p.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left")
                  .select("id", F.coalesce("top", "up").alias("up")))
        p = written(p, "parents")
        if found is None:
            found = p.select("id", F.col("up").alias("component"))
        else:
            moved = (found.join(p.select(F.col("id").alias("component"), "up"), "component", "left")
                          .select("id", F.coalesce("up", "component").alias("component")))
            new = p.join(found.select("id"), "id", "left_anti")
            found = written(moved.union(new.select("id", F.col("up").alias("component"))), "labels")
        for c in "ab":
            e = (e.join(p.select(F.col("id").alias(c), "up"), c, "left")
                  .withColumn(c, F.coalesce("up", c)).drop("up"))
        e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        if e.isEmpty():
            return found
