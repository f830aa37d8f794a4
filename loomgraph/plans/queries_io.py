"""Queries that go through files: each writes to the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import dataset, retrieve, traverse
from loomgraph.operators import graph as G
from loomgraph.plans import inputs as I
from loomgraph.plans.iterate import work_dir
from loomgraph.plans.registry import query, table
from loomgraph.sources import files, graph_io, sinks
from loomgraph.streaming import ingest

c = F.col
EDGES = I.business("SELECT src, dst, relation FROM ed")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(EDGES)
def s15_k3_node_link(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "node-link")
    graph_io.write_node_link(*I.business_graph(spark, d), at)
    return graph_io.read_node_link(spark, at)[1].select("src", "dst", "relation")


@query(EDGES)
def k4_nodes_edges(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "nodes-edges")
    graph_io.write_nodes_edges(*I.business_graph(spark, d), at)
    return graph_io.read_nodes_edges(spark, at)[1].select("src", "dst", "relation")


@query(EDGES)
def s15_k3_graphml(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "graphml")
    graph_io.write_graphml(*I.business_graph(spark, d), at)
    return graph_io.read_graphml(spark, f"{at}/nodes", f"{at}/edges")[1].select("src", "dst", "relation")


@query(I.business("SELECT src, dst, CAST(1.0 AS DOUBLE) AS weight FROM ed"))
def s15_k3_gexf(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "gexf")
    graph_io.write_gexf(*I.business_graph(spark, d), at)
    return graph_io.read_gexf(spark, f"{at}/edges")[1]


@query(EDGES)
def s16_k7_schema(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "schema")
    graph_io.write_schema(*I.business_graph(spark, d), at)
    return graph_io.read_schema(spark, at)[1].select("src", "dst", "relation")


@query(I.business("SELECT src, dst, relation FROM ed WHERE relation = 'HAS_PART'"))
def k6_tables_pruned_by_relation(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "tables")
    graph_io.write_tables(*I.business_graph(spark, d), at)
    return graph_io.read_tables(spark, at)[1].where("relation = 'HAS_PART'").select("src", "dst", "relation")


@query(f"WITH {I.TRIPLES} SELECT doc_id, triple_seq, subject, relation, object FROM tr")
def k2_triples(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "triples")
    sinks.write_triples(I.doc_triples(spark, d), at)
    return spark.read.parquet(at).select("doc_id", "triple_seq", "subject", "relation", "object")


@query(f"WITH {I.CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS source, CAST(max(total_chunks) AS INTEGER) AS chunks, md5(any_value(t)) AS content FROM ch JOIN dt USING (doc_id) GROUP BY doc_id")
def s13_k1_json_documents(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "json")
    t = T.clean(c("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(t.alias("content"), T.fixed_chunks(t).alias("chunks"), F.create_map(F.lit("source"), c("doc_id").cast("string")).alias("metadata"))
    sinks.write_documents(rows, at)
    back = files.json_documents(spark, f"{at}/documents")
    return back.select(c("metadata")["source"].alias("source"), F.size("chunks").alias("chunks"), F.md5("content").alias("content"))


@query(f"SELECT lang AS folder, count(*) AS files, CAST(sum(length({I.clean_sql('text')})) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def s1_s4_text_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of text, scanned and cleaned."""
    at = _folder(spark, "files")
    sinks.write_texts(table(spark, d, "documents").where("text IS NOT NULL").select("lang", "text"), at, "lang")
    found = files.scan(spark, at)
    text = T.clean(F.decode("content", "UTF-8"))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(text)).alias("n_chars"))


#: Endings of the file names of pages, by page_id; the last two are for no reader.
ENDINGS = (".md", ".MARKDOWN", ".txt", ".Pdf", ".docx", ".jpeg", ".TIFF", ".url", ".mkv", ".zip", "")
_READER = "CASE i WHEN 0 THEN 'markdown' WHEN 1 THEN 'markdown' WHEN 2 THEN 'markdown' WHEN 3 THEN 'pdf' WHEN 4 THEN 'docx' WHEN 5 THEN 'image' WHEN 6 THEN 'image' WHEN 7 THEN 'video' WHEN 8 THEN 'video' END"


@query(f"SELECT page_id, lower({list(ENDINGS)}[i + 1]) AS file_type, {_READER} AS reader FROM (SELECT page_id, page_id % {len(ENDINGS)} AS i FROM pages)")
def s2_s3_readers(spark: SparkSession, d: str) -> DataFrame:
    """The reader that takes a file, by the ending of its name in any case."""
    ending = F.get(F.array(*[F.lit(x) for x in ENDINGS]), (c("page_id") % len(ENDINGS)).cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("/data/v1.2/page"), ending).alias("path"))
    return rows.select("page_id", files.extension(c("path")).alias("file_type"), files.reader(c("path")).alias("reader"))


@query("SELECT lang AS folder, '.txt' AS file_type, 'markdown' AS reader, count(*) AS files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY lang")
def s14_file_stats(spark: SparkSession, d: str) -> DataFrame:
    """Types and sizes of files, each the text of a document and a line end; their contents are not read."""
    at = _folder(spark, "stats")
    sinks.write_texts(table(spark, d, "documents").where("text IS NOT NULL").select("lang", "text"), at, "lang")
    found = files.scan(spark, at).withColumn("folder", F.regexp_extract("path", "lang=([^/]*)/", 1))
    return found.groupBy("folder", "file_type", "reader").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT CASE WHEN r < CAST(floor(0.8 * n) AS BIGINT) THEN 'train' WHEN r < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1""")
def k9_s19_dataset(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "dataset")
    rows = table(spark, d, "documents").select("doc_id", c("text").alias("input"), c("lang").alias("output"))
    sinks.write_dataset(dataset.split(rows, "doc_id"), at)
    return spark.read.schema("input string, output string, split string").json(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {I.CHUNKS} SELECT count(*) * 2 AS total_documents, CAST(64 AS INTEGER) AS dimension FROM ch WHERE chunk <> ''")
def k10_index_append(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "index")
    t = T.clean(c("text"))
    rows = retrieve.index_rows(table(spark, d, "documents").select("doc_id", t.alias("content"), T.fixed_chunks(t).alias("chunks")))
    for _ in range(2):
        sinks.append_index(retrieve.build_index(rows, 64), at)
    return retrieve.index_statistics(spark.read.parquet(at))


@query(I.business("SELECT count(*) AS total_nodes, (SELECT count(*) FROM ed) AS total_edges, (SELECT count(DISTINCT component) FROM cc) AS num_components FROM nd", I.COMPONENTS))
def a4_combined_statistics(spark: SparkSession, d: str) -> DataFrame:
    return traverse.combined_statistics(*I.business_graph(spark, d)).select("total_nodes", "total_edges", "num_components")


@query(I.business("SELECT src, dst, relation, edge_seq FROM ed"))
def f28_json_rows(spark: SparkSession, d: str) -> DataFrame:
    e = I.business_graph(spark, d)[1]
    return sinks.from_json_rows(sinks.to_json_rows(e), e.schema.simpleString()).select("src", "dst", "relation", "edge_seq")


@query(I.docs_graph("SELECT src, dst, relation, n_provenance FROM ed"))
def x_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents land as captures and a stream grows the graph of all of them."""
    at = _folder(spark, "stream")
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    landed = rows.select(F.concat(F.lit("http://example.com/"), c("doc_id").cast("string")).alias("url"), F.lit("t").alias("title"), c("text").alias("content"), F.lit("2024-01-01T00:00:00").cast("timestamp").alias("savedAt"))
    landed.write.json(f"{at}/landing")
    ingest.grow(spark, f"{at}/landing", f"{at}/graph", f"{at}/checkpoint").awaitTermination()
    return ingest.latest(spark, f"{at}/graph", f"{at}/checkpoint")[1].select("src", "dst", "relation", "n_provenance")


@query(I.docs_graph("SELECT id, label FROM nd ORDER BY node_seq, id LIMIT 10"))
def w4_first_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(I.doc_triples(spark, d)).orderBy("node_seq", "id").limit(10).select("id", "label")
