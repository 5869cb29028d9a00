"""Connected components of an edge table, never leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.staging import stage


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(id, component) of every vertex with an edge; component is the smallest id reached.

    Each round every vertex takes the smallest component among its own and its neighbours', then that of
    the vertex named by it (a jump), so the rounds grow with the logarithm of the longest chain. A round
    is written to the shared folder; the loop ends when one changes nothing. Self-loops and repeated
    edges do no harm; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
    both = stage(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "edges")
    comp = stage(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")), "component")
    for _ in range(most):
        near = both.join(comp.select(F.col("id").alias("to"), F.col("component").alias("c")), "to")
        near = near.groupBy("id").agg(F.min("c").alias("c"))
        nxt = comp.join(near, "id").select("id", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = comp.select(F.col("id").alias("component"), F.col("component").alias("c"))
        nxt = nxt.join(jump, "component", "left").select("id", F.least("component", "c").alias("component"), "old")
        nxt = stage(nxt, "component")
        if nxt.filter("component <> old").isEmpty():
            return nxt.select("id", "component")
        comp = nxt.select("id", "component")
    raise RuntimeError("components did not settle")
