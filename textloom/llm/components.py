"""Connected components of an edge table by repeated hooking and contraction.

Every node takes the least label among itself and its neighbours, edges are rewritten between labels, and those within
one label vanish; each round at least halves the nodes that still have edges. Least neighbours are pre-aggregated
before the shuffle and joined back by plain equi-joins that adaptive execution can split, so a node with
very many edges doesn't gather them in one task. Rounds are cut by tables in the shared folder. Nothing but the
number of remaining edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every node with an edge; label is the least node that it is connected with. Self-edges and repeated edges don't matter."""
    spark = edges.sparkSession
    left = stage(spark, edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    maps = []
    while left.limit(1).count():
        both = left.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("other")))
        label = stage(spark, both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")
        maps.append(label)
        la, lb = label.select(F.col("id").alias("a"), F.col("label").alias("x")), label.select(F.col("id").alias("b"), F.col("label").alias("y"))
        moved = left.join(la, "a").join(lb, "b").filter("x != y")
        left = stage(spark, moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out = maps[0]
    for m in maps[1:]:
        nxt = m.select(F.col("id").alias("label"), F.col("label").alias("next"))
        out = out.join(nxt, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return out
