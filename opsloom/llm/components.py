"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsloom.session import written


BROADCAST_ROWS = 1_000_000  # rows of two ids; longer pointer tables are joined by shuffling both sides


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be sent to all tasks if it was counted as small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id that can be reached) of every vertex of ``edges`` (``a``, ``b``).

    Every round points each vertex at its smallest neighbour or itself and contracts the edges to the pointers; what is
    left shrinks at least by half on stars and chains alike. All state is in tables.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        down = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to")), "cc-down")
        n = down.count()
        to = lambda c: small(down.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")), n)
        # One step further down: where a pointer ends in another pointer, both are followed.
        down = down.join(to("to"), "to", "left").select("id", F.coalesce("to_to", "to").alias("to"))
        down = written(down, "cc-down")
        labels = down.withColumnRenamed("to", "component") if labels is None else (
            labels.join(small(down.select(F.col("id").alias("component"), "to"), n), "component", "left")
            .select("id", F.coalesce("to", "component").alias("component")))
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = written(moved.filter("a < b").distinct(), "cc-edges")
        if not edges.isEmpty():
            labels = written(labels, "cc-labels")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
