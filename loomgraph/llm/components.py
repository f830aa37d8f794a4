"""Connected components of an edge table, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut

MOST_ROUNDS = 60


def _min_neighbour(sym: DataFrame) -> DataFrame:
    """Smallest neighbour; written, so that the join after it is one of two
    plain shuffles, which adaptive execution can split at a hot node."""
    return cut(sym.groupBy("a").agg(F.min("b").alias("m")), "cc-min")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs), root the
    smallest node it is joined to.

    Alternates large stars (larger neighbours move to the smallest one) and
    small stars until nothing changes; every round is written to the shared
    folder, so no lineage grows, and only one count comes to the driver.
    Loops and repeated edges are fine; without edges there are no rows.
    """
    work = cut(edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "cc")
    seen = None
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour of a node joins its smallest neighbour
        sym = work.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(work.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
        low = _min_neighbour(sym).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("m").alias("lo"), F.col("b").alias("hi")).where("lo != hi").distinct()
        # small star: smaller neighbours of a node join the smallest of them
        down = large.select(F.col("hi").alias("a"), F.col("lo").alias("b"))
        low = _min_neighbour(down)
        small = down.join(low, "a").select(F.col("m").alias("lo"), F.col("b").alias("hi")).where("lo != hi").unionByName(low.select(F.col("m").alias("lo"), F.col("a").alias("hi"))).distinct()
        work = cut(small, "cc")
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = work.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(work.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
