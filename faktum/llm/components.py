"""Connected components of a table of links, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm.store import released, saved


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star (both ways): larger neighbours of u go to u's least neighbour. Small star: the smaller ones and u do."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if both:
        return joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): each linked node and the least node that it can reach. Loops and repeated links do no harm."""
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        before, edges = edges, saved(_star(_star(edges, True).distinct(), False).distinct(), "edges")
        released(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
