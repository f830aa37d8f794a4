"""Reading and writing graphs: node-link JSON, GraphML, GEXF, schema JSON, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_LINK = "nodes array<struct<id:string,label:string,type:string,node_seq:decimal(38,0),mentions:bigint>>, links array<struct<source:string,target:string,key:string,relation:string,type:string,confidence:double,edge_seq:decimal(38,0),n_provenance:bigint>>"

NODES_EDGES = "nodes array<struct<id:string,label:string,type:string>>, edges array<struct<source:string,target:string,relation:string,type:string,confidence:double>>"


def write_tables(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Parquet tables: the form to work with; edges by relation for pruning."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{folder}/edges")


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_node_link(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One JSON value with all nodes and links, for graphs that other tools load whole."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label", "type", "node_seq", "mentions"))).alias("nodes"))
    link = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("key"), "relation", "type", "confidence", "edge_seq", "n_provenance")
    e = edges.agg(F.array_sort(F.collect_list(link)).alias("links"))
    one = n.crossJoin(e).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links")).alias("value"))  # one row each
    one.write.mode("overwrite").text(folder)


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(NODE_LINK).option("multiLine", True).json(path)
    nodes = rows.select(F.inline("nodes"))
    edges = rows.select(F.inline("links")).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("relation", "key").alias("relation"), "type", "confidence", "edge_seq", "n_provenance")
    return nodes, edges


def write_nodes_edges(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One JSON value {nodes, edges}, as a graph database is exported: nodes
    with their properties, edges with theirs and the keys of both ends."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label", "type"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "type", "confidence"))).alias("edges"))
    n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("value")).write.mode("overwrite").text(folder)  # one row each


def read_nodes_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(NODES_EDGES).option("multiLine", True).json(path)
    return rows.select(F.inline("nodes")), rows.select(F.inline("edges")).withColumnsRenamed({"source": "src", "target": "dst"})


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """GraphML element rows, one file a part: XML rows of nodes and edges with scalar attributes."""
    n = nodes.select(F.col("id").alias("_id"), F.array(F.struct(F.lit("label").alias("_key"), F.col("label").alias("_VALUE")), F.struct(F.lit("type").alias("_key"), F.col("type").alias("_VALUE"))).alias("data"))
    e = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.array(F.struct(F.lit("relation").alias("_key"), F.col("relation").alias("_VALUE")), F.struct(F.lit("confidence").alias("_key"), F.col("confidence").cast("string").alias("_VALUE"))).alias("data"))
    n.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", "node").save(f"{folder}/nodes")
    e.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", "edge").save(f"{folder}/edges")


_DATA = "array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, nodes_path: str, edges_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, label, type) and (src, dst, relation, confidence); one file with both works too."""
    attr = lambda name: F.get(F.filter("data", lambda d: d["_key"] == name), F.lit(0))["_VALUE"]
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {_DATA}").load(nodes_path)
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {_DATA}").load(edges_path or nodes_path)
    return (
        n.select(F.col("_id").alias("id"), attr("label").alias("label"), attr("type").alias("type")),
        e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attr("relation").alias("relation"), attr("confidence").cast("double").alias("confidence")),
    )


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    n = spark.read.format("xml").option("rowTag", "node").schema("_id string, _label string").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, _weight double").load(path)
    return n.select(F.col("_id").alias("id"), F.col("_label").alias("label")), e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_weight").alias("weight"))


def write_gexf(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    n = nodes.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    e = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.col("confidence").alias("_weight"))
    n.write.mode("overwrite").format("xml").option("rootTag", "gexf").option("rowTag", "node").save(f"{folder}/nodes")
    e.write.mode("overwrite").format("xml").option("rootTag", "gexf").option("rowTag", "edge").save(f"{folder}/edges")


SCHEMA = "nodes map<string,struct<id:string,label:string,type:string>>, edges array<struct<source_id:string,target_id:string,relation:string,type:string,confidence:double>>"


def write_schema(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Schema JSON: nodes by key, edges, and counts."""
    n = nodes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("id", "label", "type").alias("n"))))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "relation", "type", "confidence"))).alias("edges"))
    stats = F.struct(F.size("nodes").alias("total_nodes"), F.size("edges").alias("total_edges"))
    n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges", stats.alias("statistics"))).alias("value")).write.mode("overwrite").text(folder)  # one row each


def read_schema(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    nodes = rows.select(F.explode(F.map_values("nodes")).alias("n")).select("n.*")
    return nodes, rows.select(F.inline("edges")).withColumnsRenamed({"source_id": "src", "target_id": "dst"})


def clear(folder: str, like: DataFrame) -> None:
    """Empty a table, keeping its schema."""
    like.limit(0).write.mode("overwrite").parquet(folder)


#: Data source of the separate connector; it is not bundled, and these two functions are not tested here.
NEO4J = "org.neo4j.spark.DataSource"


def read_neo4j(spark: SparkSession, url: str, label: str = "Concept", **options: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a label and the relations among them, where the connector is on the class path."""
    n = spark.read.format(NEO4J).option("url", url).options(**options).option("labels", label).load()
    e = spark.read.format(NEO4J).option("url", url).options(**options).option("query", f"MATCH (a:{label})-[r]->(b:{label}) RETURN a.id AS src, b.id AS dst, r.relation AS relation, r.confidence AS confidence").load()
    return n, e


def write_neo4j(nodes: DataFrame, edges: DataFrame, url: str, label: str = "Concept", **options: str) -> None:
    """Merge nodes by id and edges by (src, dst, relation)."""
    nodes.write.format(NEO4J).mode("overwrite").option("url", url).options(**options).option("labels", label).option("node.keys", "id").save()
    query = f"MERGE (a:{label} {{id: event.src}}) MERGE (b:{label} {{id: event.dst}}) MERGE (a)-[r:RELATED {{relation: event.relation}}]->(b) SET r.confidence = event.confidence"
    edges.write.format(NEO4J).mode("overwrite").option("url", url).options(**options).option("query", query).save()
