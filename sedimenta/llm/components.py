"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each node of ``edges`` (a, b: long): c is the least node of its component.

    In each round a node takes the least label among its neighbours and then the label of that label, so the
    rounds grow with the logarithm of a component's width. Minima are taken before rows meet: the centre of a
    large star gets one row from each task.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut(edges.select("a", "b").unionByName(back).filter("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")))
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("v"))
            .groupBy("a")
            .agg(F.min("c").alias("m"))
        )
        taken = cut(labels.join(near, F.col("v") == F.col("a")).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        jump = taken.select(F.col("v").alias("w"), F.col("c").alias("next"))
        new = cut(taken.join(jump, F.col("c") == F.col("w")).select("v", "old", F.least("c", "next").alias("c")))
        labels = new.select("v", "c")
        if new.filter("c <> old").isEmpty():
            return labels
