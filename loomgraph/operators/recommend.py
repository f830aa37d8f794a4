"""Recommendations and learning paths over a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import traverse
from loomgraph.plans.iterate import settle

ITEM = ("concept", "priority", "reasoning", "difficulty", "section", "ord")


def _item(concept, priority, reasoning, level, section, order):
    return [concept.alias("concept"), priority.cast("double").alias("priority"), reasoning.alias("reasoning"), F.lit(level).alias("difficulty"), F.lit(section).alias("section"), order.alias("ord")]


def _unknown(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    return rows if known is None else rows.join(known.select(F.col("concept")), "concept", "left_anti")


def from_topic(node_rows: DataFrame, edge_rows: DataFrame, topic: str, known: DataFrame | None = None) -> DataFrame:
    """Items around a topic: its first 5 successors, the first 3 successors of
    each successor, its first 3 predecessors; known concepts are left out."""
    at = settle(G.resolve_topic(node_rows, topic))
    hop = G.pairs(edge_rows)
    own = settle(hop.join(at.select(F.col("id").alias("src")), "src"))
    first = Window.partitionBy("src").orderBy("adj_seq", "dst")
    near = own.withColumn("i", F.row_number().over(first))
    zero = F.lit(0).cast("long")
    direct = near.where("i <= 5").select(*_item(F.col("dst"), F.lit(0.8), F.concat(F.lit(f"Directly related to {topic} via "), "relation"), "medium", 1, F.struct(F.col("adj_seq").alias("a"), zero.alias("b"))))
    via = own.select(F.col("src").alias("topic"), F.col("dst").alias("src"), F.col("adj_seq").alias("first_seq"))
    step = hop.join(via, "src").withColumn("i", F.row_number().over(first)).where("i <= 3 AND dst != topic")
    second = step.select(*_item(F.col("dst"), F.lit(0.6), F.concat(F.lit("Related through "), "src"), "medium", 2, F.struct(F.col("first_seq").alias("a"), F.col("adj_seq").alias("b"))))
    back = hop.join(at.select(F.col("id").alias("dst")), "dst").withColumn("i", F.row_number().over(Window.partitionBy("dst").orderBy("adj_seq", "src")))
    before = back.where("i <= 3").select(*_item(F.col("src"), F.lit(0.9), F.lit(f"Prerequisite for understanding {topic}"), "easy", 3, F.struct(F.col("adj_seq").alias("a"), zero.alias("b"))))
    return _unknown(direct.unionByName(second).unionByName(before), known)


def important(node_rows: DataFrame, edge_rows: DataFrame, known: DataFrame | None = None, most: int = 10, by: str = "pagerank", rounds: int = 100) -> DataFrame:
    """Items for the most important nodes by PageRank, or by degree over the largest degree."""
    if by == "pagerank":
        score = traverse.pagerank(node_rows, edge_rows, rounds).select("id", F.col("rank").alias("score"))
    else:
        deg = G.degrees(node_rows, edge_rows)
        score = deg.crossJoin(deg.agg(F.max("degree").alias("m"))).select("id", F.when(F.col("m") > 0, F.col("degree") / F.col("m")).otherwise(0.0).alias("score"))  # one row
    top = score.join(node_rows.select("id", "node_seq"), "id").orderBy(F.desc(F.round("score", 12)), "node_seq", "id").limit(most)
    why = F.concat(F.lit("Central concept in the knowledge graph (importance: "), F.format_string("%.2f", "score"), F.lit(")"))
    return _unknown(top.select(*_item(F.col("id"), F.col("score"), why, "medium", 4, F.struct(F.col("node_seq").alias("a"), F.lit(0).cast("long").alias("b")))), known)


def rank(items: DataFrame, interests: list[str] = (), most: int | None = 5) -> DataFrame:
    """The first item of each concept, priority times 1.2 where an interest
    occurs in its name, by priority."""
    first = items.withColumn("i", F.row_number().over(Window.partitionBy("concept").orderBy("section", "ord"))).where("i = 1").drop("i")
    liked = reduce(lambda a, b: a | b, [F.contains(F.lower("concept"), F.lit(x.lower())) for x in interests], F.lit(False))
    scored = first.withColumn("priority", F.when(liked, F.col("priority") * 1.2).otherwise(F.col("priority")))
    ordered = scored.orderBy(F.desc("priority"), "section", "ord", "concept")
    return (ordered if most is None else ordered.limit(most)).select("concept", "priority", "reasoning", "difficulty")


def recommend(node_rows: DataFrame, edge_rows: DataFrame, topic: str | None = None, known: DataFrame | None = None, interests: list[str] = (), most: int = 5) -> DataFrame:
    """Next steps: around a topic, or the most important concepts."""
    items = from_topic(node_rows, edge_rows, topic, known) if topic else important(node_rows, edge_rows, known)
    return rank(items, interests, most)


def learning_path(node_rows: DataFrame, edge_rows: DataFrame, goal: str, starts: list[str] | None = None) -> DataFrame:
    """(step, concept, priority, difficulty, prerequisites, related, total,
    estimated_time) of the shortest path from a start to the goal.

    Starts: those given that exist, else nodes without edges in, else the
    first five; the first start with the shortest path wins.
    """
    goal_row = settle(G.resolve_topic(node_rows, goal))
    if starts:
        wanted = [s.lower().replace(" ", "_") for s in starts]
        begin = node_rows.where(F.col("id").isin(wanted))
    else:
        begin = node_rows.join(edge_rows.select(F.col("dst").alias("id")), "id", "left_anti")
    begin = settle(begin.select("id", "node_seq"))
    if begin.isEmpty():
        begin = settle(node_rows.orderBy("node_seq", "id").limit(5).select("id", "node_seq"))
    # backwards from the goal: one search however many starts there are
    reverse = edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "edge_seq")
    reach = settle(traverse.bfs(reverse, goal_row))
    best = reach.join(begin, "id").orderBy("d", "node_seq", "id").limit(1).select("id", "d")
    follow = reach.where("parent IS NOT NULL").select(F.col("id").alias("at"), "parent")
    row = best.select(F.array("id").alias("path"), F.col("id").alias("tip"), "d")
    length = row.first()
    for _ in range(length["d"] if length else 0):
        row = row.join(follow, F.col("tip") == F.col("at")).select(F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("tip"), "d")
    n = F.col("d") + 1
    steps = row.select("path", n.alias("total"), F.posexplode("path").alias("step", "concept"))
    near = G.pairs(edge_rows).withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("adj_seq", "dst"))).where("i <= 3")
    near = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "dst"))).alias("r"))
    out = steps.join(near, F.col("concept") == F.col("src"), "left")
    i = F.col("step")
    before = F.slice("path", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
    return out.select(
        (i + 1).alias("step"), "concept", (1.0 - i / F.col("total")).alias("priority"), T.difficulty(i, F.col("total")).alias("difficulty"),
        F.when(i == 0, F.array().cast("array<string>")).otherwise(before).alias("prerequisites"), F.coalesce(F.transform("r", lambda x: x["dst"]), F.array().cast("array<string>")).alias("related"),
        "total", T.time_needed(F.col("total")).alias("estimated_time"),
    ).orderBy("step")


def weak_areas(edge_rows: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """Predecessors of known concepts that are not known, first ``most`` in order of (known concept, edge)."""
    hop = G.pairs(edge_rows).join(known.select(F.col("concept").alias("dst")), "dst").select(F.col("src").alias("concept"), "dst", "adj_seq")
    return hop.join(known.select("concept"), "concept", "left_anti").orderBy("dst", "adj_seq", "concept").limit(most).select("concept", F.concat(F.lit("Prerequisite for "), "dst", F.lit(" but not yet mastered")).alias("reasoning"))


def learn(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known concepts with new ones added."""
    return known.select("concept").unionByName(new.select("concept")).distinct()


def profile_summary(known: DataFrame, interests: list[str] = ()) -> DataFrame:
    return known.agg(F.count_distinct("concept").alias("known_concepts")).withColumn("interests", F.lit(", ".join(interests)))
