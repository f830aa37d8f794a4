"""The three ways through the engine: files to triples, triples to analyses, questions to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import extract, link, reason, recommend, retrieve
from loomgraph.operators import graph as G
from loomgraph.plans.config import Config
from loomgraph.plans.iterate import settle
from loomgraph.sources import files


def ingest(spark: SparkSession, folder: str, config: Config = Config()) -> DataFrame:
    """(doc_id, content, chunks, metadata) of the readable files of a folder; ids follow the order of their paths."""
    found = settle(files.good(files.documents(spark, folder, config.chunk_size, config.chunk_overlap)))
    ids = settle(found.select("path").orderBy("path").withColumn("doc_id", F.monotonically_increasing_id()))
    return found.join(ids, "path")


def extract_documents(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Triples of documents that are chunked already."""
    rows = docs.select("doc_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    return extract.triples(rows, config.extract_confidence, config.triples_per_chunk)


def resolve(triples: DataFrame, config: Config = Config(), known: DataFrame | None = None) -> DataFrame:
    """Triples under the canonical names of their entities, or of those of ``known`` triples."""
    return link.link(triples, config.link_similarity, config.clustering, config.min_cluster_size, known)


def build(triples: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written once as several analyses read them."""
    return settle(G.nodes(triples)), settle(G.edges(triples, config.edge_confidence))


def analyse(triples: DataFrame, topic: str | None = None, config: Config = Config()) -> dict[str, DataFrame]:
    nodes, edges = build(settle(resolve(settle(triples), config)), config)
    out = reason.analyse(nodes, edges, config)
    return out | {"nodes": nodes, "edges": edges, "recommendations": recommend.recommend(nodes, edges, topic, most=config.recommendations)}


def ask(index: DataFrame, questions: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Answers to questions (query_id, question) with graph context."""
    asked = questions.select("query_id", retrieve.encode(F.col("question")).alias("qvec"))
    hits = retrieve.retrieve(index, asked, config.top_k, config.similarity).join(index.select("id", "text"), "id")
    return {"results": hits, "context": retrieve.context(hits, nodes, edges), "answers": retrieve.answer(hits)}
