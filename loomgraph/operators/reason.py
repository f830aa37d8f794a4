"""Gaps, contradictions, threads and inferred links of a graph.

Caps on how many nodes are scanned and results returned are part of what
these analyses are; they are applied before the joins and in order of first
appearance (``*_seq``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import traverse
from loomgraph.plans.config import Config
from loomgraph.plans.iterate import settle

#: Relations that contradict each other.
CONTRADICTIONS = (("SIMILAR_TO", "DIFFERS_FROM"), ("IS_A", "IS_NOT"), ("CAUSES", "PREVENTS"))
#: Relations that compose with themselves.
TRANSITIVE = ("IS_A", "HAS_PART", "CAUSES", "LEADS_TO", "BEFORE")


def transitive_relation(first: Column, second: Column) -> Column:
    """Relation of A to C from those of A to B and B to C."""
    return F.when((first == second) & first.isin(*TRANSITIVE), first).otherwise("RELATED_TO")


def first_nodes(node_rows: DataFrame, most: int) -> DataFrame:
    return node_rows.orderBy("node_seq", "id").limit(most).select("id", "node_seq")


def inferred(node_rows: DataFrame, edge_rows: DataFrame, scan: int | None = 30, most: int | None = 20) -> DataFrame:
    """(source, via, target, relation, confidence): two-step connections
    without a direct edge, from the first ``scan`` nodes, the first ``most``.
    ``None`` scans or returns all."""
    hop = G.pairs(edge_rows)
    a = hop.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("r1"), F.col("adj_seq").alias("s1"))
    b = hop.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("relation").alias("r2"), F.col("adj_seq").alias("s2"))
    scanned = node_rows.select("id", "node_seq") if scan is None else first_nodes(node_rows, scan)
    a = a.join(scanned.select(F.col("id").alias("a"), "node_seq"), "a")
    two = a.join(b, "b").where("a != c").join(hop.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti")
    out = two.select(F.col("a").alias("source"), F.col("b").alias("via"), F.col("c").alias("target"), transitive_relation(F.col("r1"), F.col("r2")).alias("relation"), F.lit(0.6).alias("confidence"), "node_seq", "s1", "s2")
    if most is not None:
        out = out.orderBy("node_seq", "source", "s1", "s2", "via", "target").limit(most)
    return out.select("source", "via", "target", "relation", "confidence")


def contradictions(node_rows: DataFrame, edge_rows: DataFrame, scan: int | None = 50, most: int | None = 10) -> DataFrame:
    """(source, target, relation_1, relation_2, confidence): pairs that carry
    two contradicting relations."""
    scanned = node_rows.select("id", "node_seq") if scan is None else first_nodes(node_rows, scan)
    near = edge_rows.join(scanned.select(F.col("id").alias("src"), "node_seq"), "src")
    sets = near.groupBy("src", "dst", "node_seq").agg(F.min("edge_seq").alias("adj_seq"), F.collect_set("relation").alias("relations"))
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(CONTRADICTIONS)])
    hit = F.filter(rules, lambda r: F.array_contains(F.col("relations"), r["x"]) & F.array_contains(F.col("relations"), r["y"]))
    rows = sets.select("src", "dst", "node_seq", "adj_seq", F.explode(hit).alias("r"))
    out = rows.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("r.x").alias("relation_1"), F.col("r.y").alias("relation_2"), F.lit(0.9).alias("confidence"), "node_seq", "adj_seq", F.col("r.i").alias("i"))
    if most is not None:
        out = out.orderBy("node_seq", "source", "adj_seq", "target", "i").limit(most)
    return out.select("source", "target", "relation_1", "relation_2", "confidence")


def degree_gaps(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes without, and with only one, connection."""
    deg = G.degrees(node_rows, edge_rows).where("degree <= 1").join(node_rows.select("id", "node_seq"), "id")
    kind = F.when(F.col("degree") == 0, "isolated_concept").otherwise("weakly_connected")
    return deg.select(F.lit(1).alias("section"), F.struct(F.col("node_seq").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d")).alias("ord"), kind.alias("type"), F.array("id").alias("related"), F.when(F.col("degree") == 0, 0.8).otherwise(0.5).alias("severity"))


def component_gaps(node_rows: DataFrame, edge_rows: DataFrame, most: int = 20) -> DataFrame:
    """Pairs of components, each named by its first node, in order of first
    appearance.  For the first ``most`` pairs the first ``most + 1``
    components are enough, so no more are paired."""
    labelled = traverse.components(node_rows, edge_rows).join(node_rows.select("id", "node_seq"), "id")
    first = labelled.groupBy("component").agg(F.min("node_seq").alias("seq"), F.min_by("id", F.struct("node_seq", "id")).alias("rep"))
    few = settle(first.orderBy("seq", "rep").limit(most + 1).select("seq", "rep"))
    a, b = few.select(F.col("seq").alias("s1"), F.col("rep").alias("r1")), few.select(F.col("seq").alias("s2"), F.col("rep").alias("r2"))
    met = a.join(b, (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("r1") < F.col("r2"))))
    return met.select(F.lit(2).alias("section"), F.struct(F.col("s1").alias("a"), F.lit("").alias("b"), F.col("s2").alias("c"), F.lit(0).cast("long").alias("d")).alias("ord"), F.lit("disconnected_components").alias("type"), F.array("r1", "r2").alias("related"), F.lit(0.9).alias("severity"))


def sibling_gaps(node_rows: DataFrame, edge_rows: DataFrame, scan: int | None = 50) -> DataFrame:
    """Pairs of successors of one node without an edge either way, for the first ``scan`` nodes."""
    scanned = node_rows.select("id", "node_seq") if scan is None else first_nodes(node_rows, scan)
    hop = G.pairs(edge_rows).select("src", "dst", "adj_seq")
    own = hop.join(scanned.select(F.col("id").alias("src"), "node_seq"), "src")
    a = own.select("src", "node_seq", F.col("dst").alias("x"), F.col("adj_seq").alias("sx"))
    b = own.select("src", F.col("dst").alias("y"), F.col("adj_seq").alias("sy"))
    met = a.join(b, "src").where((F.col("sx") < F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y"))))
    either = hop.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(hop.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    met = met.join(either, ["x", "y"], "left_anti")
    return met.select(F.lit(3).alias("section"), F.struct(F.col("node_seq").alias("a"), F.col("src").alias("b"), F.col("sx").alias("c"), F.col("sy").alias("d")).alias("ord"), F.lit("missing_link").alias("type"), F.array("src", "x", "y").alias("related"), F.lit(0.4).alias("severity"))


def gaps(node_rows: DataFrame, edge_rows: DataFrame, scan: int = 50, most: int = 20) -> DataFrame:
    """(rank, type, related, severity): the first ``most`` gaps, section by section."""
    every = degree_gaps(node_rows, edge_rows).unionByName(component_gaps(node_rows, edge_rows, most)).unionByName(sibling_gaps(node_rows, edge_rows, scan))
    few = every.orderBy("section", "ord", "related").limit(most)
    w = Window.orderBy("section", "ord", "related")  # over at most ``most`` rows
    return few.withColumn("rank", F.row_number().over(w)).select("rank", "type", "related", "severity")


def gap_summary(found: DataFrame, most: int = 3) -> DataFrame:
    """(type, n, examples): the first ``most`` of each type, in one line."""
    w = Window.partitionBy("type").orderBy("rank")
    rows = found.withColumn("i", F.row_number().over(w))
    one = F.when(F.col("i") <= most, F.struct("i", F.array_join("related", "/").alias("t")))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "; ").alias("examples"))


THREAD = "name string, nodes array<string>, edges array<struct<source:string,relation:string,target:string>>, importance double, ord bigint"


def node_threads(node_rows: DataFrame, edge_rows: DataFrame, centres: DataFrame, most_edges: int = 20) -> DataFrame:
    """Threads around ``centres`` (id, importance, ord): what two steps along
    edges reach; kept with three nodes or more."""
    hop = settle(edge_rows.select("src", "dst", "relation", "edge_seq"))
    first = centres.join(hop, centres["id"] == hop["src"]).select("id", "importance", "ord", "src", "relation", "dst", "edge_seq", F.lit(1).alias("level"))
    level1 = first.select("id", "importance", "ord", F.col("dst").alias("src")).distinct()
    second = level1.join(hop, "src").select("id", "importance", "ord", "src", "relation", "dst", "edge_seq", F.lit(2).alias("level"))
    rows = first.unionByName(second)
    edge = F.struct("level", "edge_seq", F.col("src").alias("source"), "relation", F.col("dst").alias("target"))
    built = rows.groupBy("id", "importance", "ord").agg(F.array_sort(F.collect_set("dst")).alias("reached"), F.array_sort(F.collect_list(edge)).alias("e"))
    nodes = F.array_distinct(F.concat(F.array("id"), F.col("reached")))
    cut = F.transform(F.slice("e", 1, most_edges), lambda x: F.struct(x["source"].alias("source"), x["relation"].alias("relation"), x["target"].alias("target")))
    return built.select(F.concat(F.lit("Thread: "), "id").alias("name"), nodes.alias("nodes"), cut.alias("edges"), "importance", "ord").where(F.size("nodes") >= 3)


def path_threads(node_rows: DataFrame, edge_rows: DataFrame, scan: int = 10) -> DataFrame:
    """Shortest paths of three nodes or more between the first ``scan`` nodes."""
    few = settle(first_nodes(node_rows, scan))
    reach = traverse.bfs(edge_rows, few)
    links = F.map_from_entries(F.collect_list(F.struct("id", "parent")))
    trees = reach.where("parent IS NOT NULL").groupBy("start").agg(links.alias("parents"))
    goals = reach.join(few.select("id", F.col("node_seq").alias("goal_seq")), "id").where("d >= 2").join(trees, "start").join(few.select(F.col("id").alias("start"), F.col("node_seq").alias("start_seq")), "start")
    steps = F.sequence(F.lit(1), F.col("d"))
    back = F.aggregate(steps, F.array("id"), lambda acc, _: F.concat(F.array(F.element_at("parents", F.get(acc, F.lit(0)))), acc))
    paths = goals.select("start", "id", "start_seq", "goal_seq", back.alias("nodes"))
    first = G.first_relation(edge_rows, "RELATED_TO")
    hops = paths.select("start", "id", F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("s"), F.slice("nodes", 2, F.size("nodes")).alias("t"))).alias("i", "h"))
    named = hops.join(first, (F.col("h.s") == F.col("src")) & (F.col("h.t") == F.col("dst"))).groupBy("start", "id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("src").alias("source"), "relation", F.col("dst").alias("target")))).alias("e"))
    edges = F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["relation"].alias("relation"), x["target"].alias("target")))
    order = Window.orderBy("start_seq", "goal_seq", "start", "id")  # at most scan * scan rows
    return paths.join(named, ["start", "id"]).withColumn("ord", F.row_number().over(order) + 1000).select(F.concat(F.lit("Path: "), "start", F.lit(" → "), "id").alias("name"), "nodes", edges.alias("edges"), F.lit(0.5).alias("importance"), F.col("ord").cast("long").alias("ord"))


def dedup_threads(rows: DataFrame, overlap: float = 0.8) -> DataFrame:
    """Greedy, in order: a thread goes if it shares more than ``overlap`` of
    the larger node set with one kept before.  The input is at most a few
    dozen threads, so it is one array."""
    kind = rows.select("name", "nodes", "edges", "importance", "ord")
    one = kind.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "nodes", "edges", "importance"))).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    like = lambda x, y: F.size(F.array_intersect(x["nodes"], y["nodes"])) / F.greatest(F.size(x["nodes"]), F.size(y["nodes"])) > overlap
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda y: like(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return one.select(F.explode(kept).alias("t")).select("t.name", "t.nodes", "t.edges", "t.importance", "t.ord")


def threads(node_rows: DataFrame, edge_rows: DataFrame, central: int = 10, most: int = 10) -> DataFrame:
    """Threads around the most central nodes, and along paths where those are fewer than five."""
    score = traverse.betweenness(node_rows, edge_rows).join(node_rows.select("id", "node_seq"), "id")
    top = score.orderBy(F.desc(F.round("betweenness", 12)), "node_seq", "id").limit(central)
    order = Window.orderBy(F.desc(F.round("betweenness", 12)), "node_seq", "id")  # over ``central`` rows
    centres = settle(top.select("id", F.col("betweenness").alias("importance"), F.row_number().over(order).cast("long").alias("ord")))
    found = settle(node_threads(node_rows, edge_rows, centres))
    if found.count() < 5:
        found = found.unionByName(path_threads(node_rows, edge_rows))
    return dedup_threads(found).orderBy(F.desc("importance"), "ord").limit(most)


def analyse(node_rows: DataFrame, edge_rows: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """The four analyses, each a lazy frame of its own."""
    return {
        "gaps": gaps(node_rows, edge_rows, config.gap_nodes, config.gaps),
        "contradictions": contradictions(node_rows, edge_rows, config.contradiction_nodes, config.contradictions),
        "threads": threads(node_rows, edge_rows, config.central_nodes, config.threads),
        "inferred_edges": inferred(node_rows, edge_rows, config.inference_nodes, config.inferences),
    }
