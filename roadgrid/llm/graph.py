"""Connected components by contraction; nothing of the graph comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import cut, release


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): one root a component, a node of its own.

    Each round points every node at its smallest neighbour's smallest neighbour
    (itself included) and contracts the edges to the nodes pointed at. A round
    at least halves the nodes that still have edges. Minima are aggregated
    before the shuffle, so a hub's edges don't meet in one task. The rounds'
    tables are deleted as soon as nothing reads them.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hub = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("hub"))
        first = cut(hub)
        next_hub = first.select(F.col("v").alias("hub"), F.col("hub").alias("hub2"))
        hub = cut(first.join(next_hub, "hub", "left").select("v", F.coalesce("hub2", "hub").alias("hub")))
        old, spent = labels, [first, edges]
        if labels is None:
            labels = hub.select(F.col("v").alias("node"), F.col("hub").alias("root"))
        else:
            step = hub.select(F.col("v").alias("root"), F.col("hub").alias("up"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = cut(labels)
        a = hub.select(F.col("v").alias("a"), F.col("hub").alias("ra"))
        b = hub.select(F.col("v").alias("b"), F.col("hub").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = cut(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        release(spark, hub, *spent, *([old] if old is not None else []))
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
