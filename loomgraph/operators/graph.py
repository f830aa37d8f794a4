"""Building a property multigraph from triples, and looking things up in it.

Nodes: id, label, type, node_seq, mentions, or properties and provenance where they are stated.  Edges: src, dst,
relation, type, confidence, edge_seq, provenance; one edge for each (src,
dst, relation).  ``*_seq`` carry the order of first appearance, which some
analyses are defined by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

EDGE_CONFIDENCE = 0.6


def valid(triples: DataFrame) -> DataFrame:
    """Triples whose three parts are there and not empty, with node keys."""
    full = triples.where((F.length("subject") > 0) & (F.length("relation") > 0) & (F.length("object") > 0))
    return full.withColumn("src", T.node_id(F.col("subject"))).withColumn("dst", T.node_id(F.col("object")))


def nodes(triples: DataFrame) -> DataFrame:
    """Node upsert: the first label of a key wins, mentions are counted."""
    ends = valid(triples).select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("subject").alias("label"), (F.col("triple_seq") * 2).alias("seq")),
        F.struct(F.col("dst").alias("id"), F.col("object").alias("label"), (F.col("triple_seq") * 2 + 1).alias("seq")),
    )).alias("n")).select("n.*")
    return ends.groupBy("id").agg(
        F.min_by("label", "seq").alias("label"), F.min("seq").alias("node_seq"), F.count(F.lit(1)).alias("mentions"),
    ).withColumn("type", F.lit("CONCEPT"))


def described_nodes(rows: DataFrame) -> DataFrame:
    """Upsert of nodes that are stated with properties: rows (seq, label, type,
    properties map<string,string>, source), null where nothing is said.  The
    first row of a key decides its label and type (none there: CONCEPT, also if
    a later row has one); of each property the last value counts; sources are
    listed in order of appearance."""
    named = rows.where(F.length("label") > 0).withColumn("id", T.node_id(F.col("label")))
    one = F.struct("seq", "source")
    out = named.groupBy("id").agg(
        F.min_by("label", "seq").alias("label"), F.min("seq").alias("node_seq"), F.coalesce(F.min_by("type", "seq"), F.lit("CONCEPT")).alias("type"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), one))), lambda x: x["source"]).alias("provenance"),
    )
    last = named.select("id", "seq", F.explode("properties")).groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
    values = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return out.join(values, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def edges(triples: DataFrame, least: float = EDGE_CONFIDENCE) -> DataFrame:
    """Edge upsert by (src, dst, relation): highest confidence, type of the
    first, provenance counted.  Weak triples give nodes but no edge."""
    strong = valid(triples).where(F.col("confidence") >= least)
    return strong.groupBy("src", "dst", "relation").agg(
        F.max("confidence").alias("confidence"), F.min("triple_seq").alias("edge_seq"), F.count(F.lit(1)).alias("n_provenance"),
    ).withColumn("type", T.edge_type(F.col("relation")))


def edge_provenance(triples: DataFrame, least: float = EDGE_CONFIDENCE) -> DataFrame:
    """(src, dst, relation, provenance): the list in order of appearance."""
    strong = valid(triples).where(F.col("confidence") >= least)
    one = F.struct("triple_seq", F.col("doc_id").cast("string").alias("source"), "method", "confidence")
    return strong.groupBy("src", "dst", "relation").agg(F.array_sort(F.collect_list(one)).alias("provenance"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two node tables: first label, all mentions."""
    both = old.unionByName(new)
    return both.groupBy("id").agg(F.min_by("label", "node_seq").alias("label"), F.min("node_seq").alias("node_seq"), F.sum("mentions").alias("mentions"), F.min_by("type", "node_seq").alias("type"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two edge tables: highest confidence, all provenance, first type."""
    both = old.unionByName(new)
    return both.groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence"), F.min("edge_seq").alias("edge_seq"), F.sum("n_provenance").alias("n_provenance"), F.min_by("type", "edge_seq").alias("type"))


def pairs(edge_rows: DataFrame) -> DataFrame:
    """(src, dst, adj_seq, relation): neighbours once each, with the order and
    the relation of the first of parallel edges."""
    return edge_rows.groupBy("src", "dst").agg(F.min("edge_seq").alias("adj_seq"), F.min_by("relation", "edge_seq").alias("relation"))


def node_by_id(node_rows: DataFrame, key: str) -> DataFrame:
    return node_rows.where(F.col("id") == key)


def node_by_label(node_rows: DataFrame, label: str) -> DataFrame:
    return node_rows.where(F.col("id") == T.node_id(F.lit(label)))


def neighbours(edge_rows: DataFrame, keys: DataFrame, direction: str = "out") -> DataFrame:
    """(id, neighbour) for the ids of ``keys``: out, in or both, each once."""
    out = edge_rows.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    back = edge_rows.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return rows.join(keys.select("id"), "id", "left_semi").distinct()


def edges_of(edge_rows: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Edges from ``src`` and to ``dst``; a pair without edges gives none."""
    if src is not None:
        edge_rows = edge_rows.where(F.col("src") == src)
    return edge_rows if dst is None else edge_rows.where(F.col("dst") == dst)


def search_labels(node_rows: DataFrame, text: str, most: int = 10) -> DataFrame:
    """The first nodes whose label contains ``text``, in any case."""
    return node_rows.where(F.lower("label").contains(text.lower())).orderBy("node_seq", "id").limit(most)


def resolve_topic(node_rows: DataFrame, topic: str) -> DataFrame:
    """One row or none: the node whose key is the topic, else the first whose key contains it."""
    exact = F.col("id") == topic.lower().replace(" ", "_")
    return node_rows.where(exact | F.col("id").contains(topic.lower())).orderBy(F.when(exact, 0).otherwise(1), "node_seq", "id").limit(1).select("id")


def degrees(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(id, degree): parallel edges count, loops count twice, no edge counts 0."""
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return node_rows.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_degree(node_rows: DataFrame, edge_rows: DataFrame, most: int = 10) -> DataFrame:
    """The best connected nodes by label."""
    return node_rows.join(degrees(node_rows, edge_rows), "id").orderBy(F.desc("degree"), "node_seq", "id").limit(most).select("id", "label", "degree")


def schema_statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: counts, mean confidence, and how many carry provenance (nodes
    that triples alone made do not)."""
    stated = F.count_if(F.size("provenance") > 0) if "provenance" in node_rows.columns else F.lit(0).cast("long")
    n = node_rows.agg(F.count(F.lit(1)).alias("total_nodes"), stated.alias("nodes_with_provenance"))
    e = edge_rows.agg(F.count(F.lit(1)).alias("total_edges"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.count_if(F.col("n_provenance") > 0).alias("edges_with_provenance"))
    return n.crossJoin(e)  # one row each


def type_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def induced(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges both ends of which are in ``node_rows`` (id)."""
    keys = node_rows.select("id")
    return edge_rows.join(keys.withColumnRenamed("id", "src"), "src", "left_semi").join(keys.withColumnRenamed("id", "dst"), "dst", "left_semi")


def first_relation(edge_rows: DataFrame, default: str | None = None) -> DataFrame:
    """(src, dst, relation) of the first edge of each pair."""
    rel: Column = F.min_by("relation", "edge_seq")
    return edge_rows.groupBy("src", "dst").agg((F.coalesce(rel, F.lit(default)) if default else rel).alias("relation"))
