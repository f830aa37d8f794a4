"""Inputs of the queries, in Spark and in SQL: chunks and triples of the
documents, and graphs over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import extract
from loomgraph.operators import graph as G
from loomgraph.plans.iterate import drop, settle  # noqa: F401
from loomgraph.plans.registry import table


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.chunks(table(spark, sf_dir, "documents"))


def doc_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_seq(extract.triples(doc_chunks(spark, sf_dir)))


def short_seq(triples: DataFrame) -> DataFrame:
    """``triple_seq`` as a long, for tables of small ids: the type the SQL has."""
    return triples.withColumn("triple_seq", F.col("triple_seq").cast("long"))


def _rows(df: DataFrame, s, r: str, o, seq) -> DataFrame:
    return df.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("chunk_index"), seq.cast("long").alias("triple_seq"), s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"), F.lit(1.0).alias("confidence"), F.lit("table").alias("method"))


def business_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as parts, brands by type, and which event follows which."""
    region, nation, supplier, part, events = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part", "events"))
    c = F.col
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select("event_id", "event_type", F.lag("event_type").over(order).alias("prev")).where("prev IS NOT NULL")
    return (
        _rows(region.join(nation, c("r_regionkey") == c("n_regionkey")), c("r_name"), "HAS_PART", c("n_name"), c("n_nationkey"))
        .unionByName(_rows(nation.join(supplier, c("n_nationkey") == c("s_nationkey")), c("n_name"), "HAS_PART", c("s_name"), c("s_suppkey") + 100_000_000))
        .unionByName(_rows(part, c("p_brand"), "IS_A", c("p_type"), c("p_partkey") + 10_000_000_000))
        .unionByName(_rows(steps, c("prev"), "LEADS_TO", c("event_type"), c("event_id") + 1_000_000_000_000))
    )


def business_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    triples = business_triples(spark, sf_dir)
    return settle(G.nodes(triples)), settle(G.edges(triples))


def contested_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part, similar by returned and different by accepted lines."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    rel = F.when(F.col("l_returnflag") == "R", "SIMILAR_TO").otherwise("DIFFERS_FROM")
    return lines.select(
        F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("chunk_index"), seq.alias("triple_seq"), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("subject"), rel.alias("relation"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("object"), (1.0 - F.col("l_discount")).alias("confidence"), F.lit("table").alias("method"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


# The same in SQL ---------------------------------------------------------

def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(0), ''), '{T.SPACE}+', ' ', 'g'))"


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda r: concat(CASE WHEN r[1:1] = 'ß' THEN 'Ss' ELSE upper(r[1:1]) END, r[2:])), '')"


def entity_sql(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '{T.SPACE}+', ' ', 'g'))"
    bare = title_sql(f"trim(regexp_replace({flat}, '^(?i)(a|an|the) +', ''))")
    return f"CASE WHEN length({bare}) > 1 THEN {bare} END"


def node_sql(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


TYPES_SQL = "(" + ", ".join(f"'{t}'" for t in T.EDGE_TYPES) + ")"

CHUNKS = f"""
  dt AS (SELECT doc_id, {clean_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
  ds AS (SELECT doc_id, t, CASE WHEN length(t) <= 512 THEN [0] ELSE range(0, CAST(ceil(length(t) / 462.0) AS INT)) END AS w FROM dt),
  ch AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks, substring(t, CAST(i * 462 + 1 AS BIGINT), 512) AS chunk FROM (SELECT doc_id, t, len(w) AS n, unnest(w) AS i FROM ds))"""


def _hits(p: int, pattern: str, rel: str) -> str:
    found = [f"regexp_extract_all(chunk, '(?i){pattern}', {g})" for g in (1, 2)]
    return f"SELECT doc_id, chunk_index, {p} AS p, unnest(range(1, len({found[0]}) + 1)) AS i, unnest({found[0]}) AS s0, '{rel}' AS relation, unnest({found[1]}) AS o0 FROM ch"


TRIPLES = CHUNKS + f""",
  mt AS ({' UNION ALL '.join(_hits(p, pattern, rel) for p, (pattern, rel) in enumerate(extract.PATTERNS))}),
  mn AS (SELECT doc_id, chunk_index, p, i, {entity_sql('s0')} AS subject, relation, {entity_sql('o0')} AS object FROM mt),
  mk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index, lower(subject), relation, lower(object) ORDER BY p, i) AS k FROM mn
    WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object),
  mr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY p, i) - 1 AS r FROM mk WHERE k = 1),
  tr AS (SELECT doc_id, chunk_index, doc_id * 1000000000 + chunk_index * 1000 + r AS triple_seq, subject, relation, object, CAST(0.7 AS DOUBLE) AS confidence FROM mr WHERE r < 10)"""

BUSINESS_TRIPLES = """
  tr AS (
    SELECT r_name AS subject, 'HAS_PART' AS relation, n_name AS object, CAST(n_nationkey AS BIGINT) AS triple_seq, CAST(1.0 AS DOUBLE) AS confidence FROM region JOIN nation ON r_regionkey = n_regionkey
    UNION ALL SELECT n_name, 'HAS_PART', s_name, s_suppkey + 100000000, 1.0 FROM nation JOIN supplier ON n_nationkey = s_nationkey
    UNION ALL SELECT p_brand, 'IS_A', p_type, p_partkey + 10000000000, 1.0 FROM part
    UNION ALL SELECT prev, 'LEADS_TO', event_type, event_id + 1000000000000, 1.0 FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL)"""

CONTESTED_TRIPLES = """
  tr AS (SELECT 'Supplier ' || l_suppkey AS subject, CASE WHEN l_returnflag = 'R' THEN 'SIMILAR_TO' ELSE 'DIFFERS_FROM' END AS relation, 'Part ' || l_partkey AS object,
    l_orderkey * 100 + l_linenumber AS triple_seq, 1.0 - l_discount AS confidence FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""

GRAPH = f""",
  tv AS (SELECT *, {node_sql('subject')} AS src, {node_sql('object')} AS dst FROM tr WHERE length(subject) > 0 AND length(relation) > 0 AND length(object) > 0),
  ne AS (SELECT src AS id, subject AS label, triple_seq * 2 AS seq FROM tv UNION ALL SELECT dst, object, triple_seq * 2 + 1 FROM tv),
  nd AS MATERIALIZED (SELECT id, arg_min(label, seq) AS label, min(seq) AS node_seq, count(*) AS mentions FROM ne GROUP BY id),
  ed AS MATERIALIZED (SELECT src, dst, relation, max(confidence) AS confidence, min(triple_seq) AS edge_seq, count(*) AS n_provenance,
    CASE WHEN upper(relation) IN {TYPES_SQL} THEN upper(relation) ELSE 'RELATED_TO' END AS type FROM tv WHERE confidence >= 0.6 GROUP BY src, dst, relation),
  pr AS MATERIALIZED (SELECT src, dst, min(edge_seq) AS adj_seq, arg_min(relation, edge_seq) AS relation FROM ed GROUP BY src, dst),
  dg AS MATERIALIZED (SELECT nd.id, count(e.id) AS degree FROM nd LEFT JOIN (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) e ON e.id = nd.id GROUP BY nd.id)"""

COMPONENTS = """,
  sy AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
  rc AS (SELECT id, id AS hit FROM nd UNION SELECT rc.id, sy.b FROM rc JOIN sy ON sy.a = rc.hit),
  cc AS MATERIALIZED (SELECT id, min(hit) AS component FROM rc GROUP BY id)"""

#: For larger graphs: each node keeps the smallest label that has come to it.
KEYED_COMPONENTS = """,
  sy AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
  cc(id, component) USING KEY (id) AS (SELECT id, id FROM nd UNION
    SELECT sy.b, min(cc.component) FROM cc JOIN sy ON sy.a = cc.id JOIN recurring.cc AS had ON had.id = sy.b WHERE cc.component < had.component GROUP BY sy.b)"""


def docs_graph(tail: str, more: str = "") -> str:
    return f"WITH RECURSIVE {TRIPLES}{GRAPH}{more} {tail}"


def business(tail: str, more: str = "") -> str:
    return f"WITH RECURSIVE {BUSINESS_TRIPLES}{GRAPH}{more} {tail}"


def contested(tail: str) -> str:
    return f"WITH {CONTESTED_TRIPLES}{GRAPH} {tail}"
