"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``edges`` (a long, b long).

    Labels are parents in trees whose ids fall towards the root. Each round takes the smallest grandparent among a node's neighbours, aggregated
    before the shuffle so that a hub is no hot key, and gives it to the node and to the node's parent, so that whole trees are
    hooked and not only their edge; then each node moves up to its grandparent. A label only ever falls and stays in its component,
    so the rounds end, and where none changes all nodes of a component have its smallest id. Each round is written, so that a
    lost executor costs one round at most.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("upper"))
        trees = cut(labels.join(up, F.col("component") == F.col("up")).select("id", "component", "upper"))
        near = both.join(trees, F.col("b") == F.col("id")).groupBy("a").agg(F.min("upper").alias("m"))
        hooked = trees.join(near, F.col("id") == F.col("a")).select("id", "component", F.least("upper", "m").alias("m"))
        moves = F.explode(F.array(F.struct("id", "m", F.col("component").alias("was")), F.struct(F.col("component").alias("id"), "m", F.lit(None).cast("long").alias("was"))))
        new = cut(hooked.select(moves.alias("x")).select("x.*").groupBy("id").agg(F.min("m").alias("component"), F.min("was").alias("was")))
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return labels
