"""Queries over graphs: building, lookups, traversal, reasoning, recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import evaluate, reason, recommend, traverse
from loomgraph.operators import graph as G
from loomgraph.plans import inputs as I
from loomgraph.plans.registry import query, table

c = F.col


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        df = df.withColumn(a, F.array_join(a, "/"))
    return df


@query(I.docs_graph("SELECT id, label, node_seq, mentions FROM nd"))
def a5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(I.doc_triples(spark, d)).select("id", "label", "node_seq", "mentions")


@query(I.docs_graph("SELECT src, dst, relation, type, confidence, edge_seq, n_provenance FROM ed"))
def a6_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(I.doc_triples(spark, d)).select("src", "dst", "relation", "type", "confidence", "edge_seq", "n_provenance")


@query(I.contested("SELECT src, dst, relation, round(confidence, 6) AS confidence, edge_seq, n_provenance FROM ed"))
def a6_p2_weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(I.contested_triples(spark, d)).select("src", "dst", "relation", F.round("confidence", 6).alias("confidence"), "edge_seq", "n_provenance")


@query(I.docs_graph("SELECT src, dst, relation, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY triple_seq) AS sources FROM tv WHERE confidence >= 0.6 GROUP BY ALL"))
def a6_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = G.edge_provenance(I.doc_triples(spark, d))
    return rows.select("src", "dst", "relation", F.array_join(c("provenance.source"), ",").alias("sources"))


@query(I.business("SELECT id, label, node_seq, mentions * 2 AS mentions FROM nd"))
def e5_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = G.nodes(I.business_triples(spark, d))
    return G.upsert_nodes(n, n).select("id", "label", "node_seq", "mentions")


@query(I.business("SELECT src, dst, relation, edge_seq, CAST(n_provenance * 2 AS BIGINT) AS n_provenance FROM ed"))
def e5_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(I.business_triples(spark, d))
    return G.upsert_edges(e, e).select("src", "dst", "relation", "edge_seq", "n_provenance")


@query(f"""SELECT {I.node_sql('p_brand')} AS id, arg_min(p_brand, p_partkey) AS label, arg_max(p_type, p_partkey) AS last_type, arg_max(CAST(p_size AS VARCHAR), p_partkey) FILTER (WHERE p_size > 25) AS last_large,
 count(*) FILTER (WHERE p_size > 10) AS n_provenance FROM part GROUP BY ALL""")
def a5_described_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "part")
    large = F.when(F.col("p_size") > 25, F.create_map(F.lit("large"), F.col("p_size").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    stated = rows.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("label"), F.lit(None).cast("string").alias("type"), F.map_concat(F.create_map(F.lit("type"), "p_type"), large).alias("properties"),
                         F.when(F.col("p_size") > 10, F.col("p_partkey").cast("string")).alias("source"))
    return G.described_nodes(stated).select("id", "label", F.col("properties")["type"].alias("last_type"), F.col("properties")["large"].alias("last_large"), F.size("provenance").cast("long").alias("n_provenance"))


@query(I.docs_graph("SELECT (SELECT count(*) FROM nd) AS total_nodes, count(*) AS total_edges, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, count(*) FILTER (WHERE n_provenance > 0) AS edges_with_provenance, CAST(0 AS BIGINT) AS nodes_with_provenance FROM ed"))
def a1_schema_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = I.doc_triples(spark, d)
    return G.schema_statistics(G.nodes(t), G.edges(t)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(I.docs_graph("SELECT type, count(*) AS n FROM ed GROUP BY type"))
def a1_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return G.type_histogram(G.edges(I.doc_triples(spark, d)))


STATS = """SELECT (SELECT count(*) FROM nd) AS num_nodes, (SELECT count(*) FROM ed) AS num_edges, (SELECT count(DISTINCT relation) FROM ed) AS num_relations, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree,
count(*) FILTER (WHERE degree > 0) AS covered, (SELECT count(DISTINCT component) FROM cc) AS num_components, (SELECT max(s) FROM (SELECT count(*) AS s FROM cc GROUP BY component)) AS largest_component,
round((SELECT count(*) FROM ed) / (count(*) * (count(*) - 1.0)), 6) AS density, (SELECT count(DISTINCT component) FROM cc) = 1 AS is_connected FROM dg"""


@query(I.business(STATS, I.COMPONENTS))
def a2_graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = traverse.graph_statistics(*I.business_graph(spark, d))
    return s.withColumn("density", F.round("density", 6)).withColumn("avg_degree", F.round("avg_degree", 6))


@query(I.business("""SELECT (SELECT count(*) FROM nd) AS unique_entities, (SELECT count(*) FROM ed) AS total_triples, (SELECT count(DISTINCT relation) FROM ed) AS total_relations,
round((SELECT count(*) FROM ed) / (count(*) * (count(*) - 1.0)), 6) AS graph_density, round(avg(degree), 6) AS avg_node_degree,
round((SELECT max(s) FROM (SELECT count(*) AS s FROM cc GROUP BY component)) / count(*), 6) AS connectivity, round(count(*) FILTER (WHERE degree > 0) / count(*), 6) AS coverage, CAST(1.0 AS DOUBLE) AS avg_confidence, CAST(1.0 AS DOUBLE) AS high_confidence_ratio FROM dg""", I.COMPONENTS))
def a12_graph_quality(spark: SparkSession, d: str) -> DataFrame:
    q = evaluate.graph_quality(*I.business_graph(spark, d))
    for x in ("graph_density", "avg_node_degree", "connectivity", "coverage"):
        q = q.withColumn(x, F.round(x, 6))
    return q


@query(I.business("""SELECT concat_ws(chr(10), CASE WHEN density < 0.01 THEN 'Low graph density: extract more relations' END, CASE WHEN conn < 0.5 THEN 'Low connectivity: link separate components' END) AS advice FROM
(SELECT (SELECT count(*) FROM ed) / (count(*) * (count(*) - 1.0)) AS density, (SELECT max(s) FROM (SELECT count(*) AS s FROM cc GROUP BY component)) / count(*) AS conn FROM dg)""", I.COMPONENTS))
def k8_advice(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.advice(evaluate.graph_quality(*I.business_graph(spark, d))).select("advice")


@query(I.business("""SELECT concat_ws(chr(10), 'Evaluation', 'unique_entities: ' || n, 'total_triples: ' || m, 'total_relations: ' || k, 'graph_density: ' || density, 'avg_node_degree: ' || degree, 'connectivity: ' || conn, 'coverage: ' || cover, 'avg_confidence: 1.0', 'high_confidence_ratio: 1.0',
CASE WHEN density < 0.01 THEN 'Low graph density: extract more relations' END, CASE WHEN conn < 0.5 THEN 'Low connectivity: link separate components' END, CASE WHEN cover < 0.7 THEN 'Low coverage: many concepts have no connection' END) AS value FROM
(SELECT count(*) AS n, any_value(m) AS m, any_value(k) AS k, any_value(m) / (count(*) * (count(*) - 1)) AS density, avg(degree) AS degree, (SELECT max(s) FROM (SELECT count(*) AS s FROM cc GROUP BY component)) / count(*) AS conn, count(*) FILTER (WHERE degree > 0) / count(*) AS cover
 FROM dg, (SELECT count(*) AS m, count(DISTINCT relation) AS k FROM ed))""", I.COMPONENTS))
def k8_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.report(evaluate.graph_quality(*I.business_graph(spark, d)))


@query(I.docs_graph("SELECT nd.id, label, CAST(degree AS BIGINT) AS degree FROM nd JOIN dg USING (id) ORDER BY degree DESC, node_seq, nd.id LIMIT 10"))
def a19_top_degree(spark: SparkSession, d: str) -> DataFrame:
    t = I.doc_triples(spark, d)
    return G.top_degree(G.nodes(t), G.edges(t))


@query(I.business("SELECT id, label FROM nd WHERE id = 'asia'"))
def j1_node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return G.node_by_label(G.nodes(I.business_triples(spark, d)), "ASIA").select("id", "label")


@query(I.business("SELECT id, neighbour FROM (SELECT src AS id, dst AS neighbour FROM ed UNION SELECT dst, src FROM ed)"))
def j2_u3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    t = I.business_triples(spark, d)
    return G.neighbours(G.edges(t), G.nodes(t), "both")


@query(I.business("SELECT src, dst, relation FROM ed WHERE src = 'click' AND dst = 'view'"))
def j3_p12_edges_between(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_of(G.edges(I.business_triples(spark, d)), "click", "view").select("src", "dst", "relation")


@query(I.business("SELECT id, label FROM nd WHERE contains(lower(label), 'nation_1') ORDER BY node_seq, id LIMIT 10"))
def p8_label_search(spark: SparkSession, d: str) -> DataFrame:
    return G.search_labels(G.nodes(I.business_triples(spark, d)), "Nation_1").select("id", "label")


@query(I.business("SELECT id FROM nd WHERE id = 'nation' OR contains(id, 'nation') ORDER BY CASE WHEN id = 'nation' THEN 0 ELSE 1 END, node_seq, id LIMIT 1"))
def p9_resolve_topic(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve_topic(G.nodes(I.business_triples(spark, d)), "NATION")


@query(I.contested("SELECT src, dst, relation FROM pr"))
def w14_first_relation(spark: SparkSession, d: str) -> DataFrame:
    return G.first_relation(G.edges(I.contested_triples(spark, d)))


@query(I.business("SELECT id, component FROM cc", I.COMPONENTS))
def c1_components(spark: SparkSession, d: str) -> DataFrame:
    return traverse.components(*I.business_graph(spark, d))


@query(I.docs_graph("SELECT component, count(*) AS size FROM cc GROUP BY component", I.KEYED_COMPONENTS))
def c1_document_components(spark: SparkSession, d: str) -> DataFrame:
    t = I.doc_triples(spark, d)
    return traverse.component_sizes(traverse.components(G.nodes(t), G.edges(t)))


PATHS = """,
  sp AS (SELECT [src, dst] AS p, dst AS hit FROM ed WHERE src = 'click' AND dst <> 'click'
    UNION ALL SELECT list_append(p, dst), dst FROM sp JOIN ed ON ed.src = sp.hit WHERE sp.hit <> 'view' AND len(p) < 4 AND NOT list_contains(p, dst))"""


@query(I.business("SELECT array_to_string(p, '/') AS path, CAST(len(p) - 1 AS INTEGER) AS n_edges FROM sp WHERE hit = 'view'", PATHS))
def c2_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return _joined(traverse.simple_paths(I.business_graph(spark, d)[1], "click", "view", 3), "path")


@query(I.business("SELECT array_to_string(p, '/') AS path, CAST(len(u) AS INTEGER) AS n_edges FROM tp WHERE hit = 'view' ORDER BY len(u), u LIMIT 10", """,
  tp AS (SELECT [src, dst] AS p, [edge_seq] AS u, dst AS hit FROM ed WHERE src = 'click'
    UNION ALL SELECT list_append(p, dst), list_append(u, edge_seq), dst FROM tp JOIN ed ON ed.src = tp.hit WHERE len(u) < 3 AND NOT list_contains(u, edge_seq))"""))
def c3_trails(spark: SparkSession, d: str) -> DataFrame:
    return _joined(traverse.trails(I.business_graph(spark, d)[1], "click", "view", 3), "path")


@query(I.business("SELECT DISTINCT id FROM (SELECT 'asia' AS id UNION ALL SELECT dst FROM pr WHERE src = 'asia' UNION ALL SELECT b.dst FROM pr a JOIN pr b ON a.dst = b.src WHERE a.src = 'asia')"))
def c4_ego_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, e = I.business_graph(spark, d)
    return traverse.ego(n, e, n.where("id = 'asia'"), 2)[0].select("id")


@query(I.business("SELECT src, dst, relation FROM ed WHERE src = 'asia'"))
def c4_ego_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = I.business_graph(spark, d)
    return traverse.ego(n, e, n.where("id = 'asia'"), 1)[1].select("src", "dst", "relation")


DISTANCES = """,
  bd AS (SELECT id AS start, id, 0 AS d FROM nd UNION SELECT bd.start, pr.dst, bd.d + 1 FROM bd JOIN pr ON pr.src = bd.id WHERE bd.d < 8)"""


@query(I.business('SELECT start, id, CAST(min(d) AS INTEGER) AS d FROM bd GROUP BY start, id', DISTANCES))
def c5_distances(spark: SparkSession, d: str) -> DataFrame:
    n, e = I.business_graph(spark, d)
    return traverse.distances(e, n)


@query(I.business("SELECT CAST(NULL AS INTEGER) AS diameter"))
def c6_diameter_unconnected(spark: SparkSession, d: str) -> DataFrame:
    return traverse.diameter(*I.business_graph(spark, d))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The connected graph of brands and types."""
    t = I.business_triples(spark, d).where("relation = 'IS_A'")
    return I.settle(G.nodes(t)), I.settle(G.edges(t))


_PART_TRIPLES = "WITH RECURSIVE tr AS (SELECT p_brand AS subject, 'IS_A' AS relation, p_type AS object, p_partkey AS triple_seq, CAST(1.0 AS DOUBLE) AS confidence FROM part)" + I.GRAPH


@query(_PART_TRIPLES + """, sy AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
 bd AS (SELECT id AS start, id, 0 AS d FROM nd UNION SELECT bd.start, sy.b, bd.d + 1 FROM bd JOIN sy ON sy.a = bd.id WHERE bd.d < 8)
 SELECT CAST(max(d) AS INTEGER) AS diameter FROM (SELECT start, id, min(d) AS d FROM bd GROUP BY start, id)""")
def c6_diameter(spark: SparkSession, d: str) -> DataFrame:
    return traverse.diameter(*_parts(spark, d))


#: wv (i, v, b): the nodes of the largest component, numbered, and as bits those within i edges; until all are.
_WAVES = I.KEYED_COMPONENTS + """,
  bg AS MATERIALIZED (SELECT arg_max(component, (n, component)) AS component FROM (SELECT component, count(*) AS n FROM cc GROUP BY component)),
  bn AS MATERIALIZED (SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS k, CAST(count(*) OVER () AS INTEGER) AS n FROM cc JOIN bg USING (component)),
  be AS MATERIALIZED (SELECT DISTINCT x.k AS a, y.k AS b FROM sy JOIN bn x ON x.id = sy.a JOIN bn y ON y.id = sy.b UNION SELECT k, k FROM bn),
  wv AS (SELECT 0 AS i, k AS v, set_bit(CAST(repeat('0', n) AS BIT), k - 1, 1) AS b FROM bn UNION ALL
    SELECT wv.i + 1, be.b, bit_or(wv.b) FROM wv JOIN be ON be.a = wv.v WHERE EXISTS (SELECT 1 FROM wv WHERE bit_count(b) < bit_length(b)) GROUP BY wv.i, be.b)"""


@query(I.docs_graph("SELECT CAST(max(i) AS INTEGER) AS diameter FROM wv", _WAVES))
def c6_document_diameter(spark: SparkSession, d: str) -> DataFrame:
    """Of the largest component of the documents' graph, whatever its size."""
    t = I.settle(I.doc_triples(spark, d))
    return traverse.largest_diameter(G.nodes(t), G.edges(t))


#: All shortest paths, and how much of those of each pair of ends lies on a node.
_LEANING = """,
  dm AS MATERIALIZED (SELECT start, id, min(d) AS d FROM bd GROUP BY start, id),
  pa AS (SELECT id AS start, id AS goal, [id] AS p FROM nd UNION ALL SELECT pa.start, pr.dst, list_append(p, pr.dst) FROM pa JOIN pr ON pr.src = pa.goal JOIN dm ON dm.start = pa.start AND dm.id = pr.dst AND dm.d = len(p)),
  pm AS MATERIALIZED (SELECT * FROM pa WHERE len(p) > 2), pc AS (SELECT start, goal, count(*) AS k FROM pm GROUP BY start, goal),
  bn AS (SELECT v, sum(1.0 / k) AS b FROM (SELECT start, goal, unnest(p[2:len(p) - 1]) AS v FROM pm) JOIN pc USING (start, goal) GROUP BY v),
  bw AS MATERIALIZED (SELECT id, label, node_seq, coalesce(b, 0) / ((n - 1) * (n - 2)) AS betweenness FROM nd LEFT JOIN bn ON v = id, (SELECT count(*) AS n FROM nd))"""

BETWEENNESS = DISTANCES + _LEANING
#: For larger graphs: distances without a bound, each pair once.
KEYED_BETWEENNESS = """,
  bd(start, id, d) USING KEY (start, id) AS (SELECT id, id, 0 FROM nd UNION SELECT bd.start, pr.dst, min(bd.d) + 1 FROM bd JOIN pr ON pr.src = bd.id
    WHERE NOT EXISTS (SELECT 1 FROM recurring.bd AS had WHERE had.start = bd.start AND had.id = pr.dst) GROUP BY bd.start, pr.dst)""" + _LEANING


@query(I.business("SELECT id, round(betweenness, 9) AS betweenness FROM bw", BETWEENNESS))
def c7_betweenness(spark: SparkSession, d: str) -> DataFrame:
    b = traverse.betweenness(*I.business_graph(spark, d))
    return b.select("id", F.round("betweenness", 9).alias("betweenness"))


@query(I.docs_graph("SELECT id, round(betweenness, 10) AS betweenness FROM bw", KEYED_BETWEENNESS))
def c7_document_betweenness(spark: SparkSession, d: str) -> DataFrame:
    t = I.settle(I.doc_triples(spark, d))
    n, e = I.settle(G.nodes(t)), I.settle(G.edges(t))
    I.drop(t)
    return traverse.betweenness(n, e).select("id", F.round("betweenness", 10).alias("betweenness"))


PAGERANK = """,
  pn AS MATERIALIZED (SELECT count(*) AS n FROM nd), oc AS (SELECT src, count(*) AS o FROM ed GROUP BY src),
  sh AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT ed.src, ed.dst, 1.0 / o AS w FROM ed JOIN oc USING (src)
      UNION ALL SELECT a.id, b.id, 1.0 / n FROM nd a, nd b, pn WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.src = a.id) UNION ALL SELECT id, id, 0 FROM nd) GROUP BY ALL),
  pk AS (SELECT id, 0 AS i, CAST(1.0 / n AS DOUBLE) AS r FROM nd, pn UNION ALL SELECT sh.dst, pk.i + 1, any_value(0.15 / n) + 0.85 * sum(pk.r * sh.w) FROM pk JOIN sh ON sh.src = pk.id, pn WHERE pk.i < 20 GROUP BY sh.dst, pk.i)"""


#: Rounds until the ranks have settled: i is the first that moves them by less than a millionth a node.
SETTLED = PAGERANK.replace("pk.i < 20", "pk.i < 100") + """,
  pl AS (SELECT coalesce(min(i), 100) AS i FROM (SELECT a.i, sum(abs(a.r - b.r)) AS moved FROM pk a JOIN pk b ON b.id = a.id AND b.i = a.i - 1 GROUP BY a.i), pn WHERE moved < n * 1e-6)"""


@query(I.business("SELECT id, round(r, 9) AS rank FROM pk JOIN pl USING (i)", SETTLED))
def c8_pagerank_settled(spark: SparkSession, d: str) -> DataFrame:
    return traverse.pagerank(*I.business_graph(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(I.business("SELECT id, round(r, 6) AS rank FROM pk WHERE i = 20", PAGERANK))
def c8_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return traverse.pagerank(*I.business_graph(spark, d), rounds=20, tolerance=0).select("id", F.round("rank", 6).alias("rank"))


#: As PAGERANK, with what nodes without edges out lose as one sum a round.
SPARSE_PAGERANK = """,
  pn AS MATERIALIZED (SELECT count(*) AS n FROM nd), oc AS MATERIALIZED (SELECT src, count(*) AS o FROM ed GROUP BY src),
  sh AS MATERIALIZED (SELECT ed.src, ed.dst, sum(1.0 / o) AS w, 0 AS lost FROM ed JOIN oc USING (src) GROUP BY ed.src, ed.dst UNION ALL SELECT id, id, 0, CASE WHEN o IS NULL THEN 1 ELSE 0 END FROM nd LEFT JOIN oc ON oc.src = nd.id),
  pk AS (SELECT id, 0 AS i, CAST(1.0 / n AS DOUBLE) AS r FROM nd, pn UNION ALL SELECT sh.dst, pk.i + 1, any_value(0.15 / n) + 0.85 * (sum(pk.r * sh.w) + sum(sum(pk.r * sh.lost)) OVER () / any_value(n)) FROM pk JOIN sh ON sh.src = pk.id, pn WHERE pk.i < 20 GROUP BY sh.dst, pk.i)"""


@query(I.docs_graph("SELECT id, round(r, 9) AS rank FROM pk WHERE i = 20", SPARSE_PAGERANK))
def c8_document_pagerank(spark: SparkSession, d: str) -> DataFrame:
    t = I.settle(I.doc_triples(spark, d))
    return traverse.pagerank(I.settle(G.nodes(t)), I.settle(G.edges(t)), rounds=20, tolerance=0).select("id", F.round("rank", 9).alias("rank"))


TWO_HOPS = """a AS (SELECT a.src AS source, a.dst AS via, b.dst AS target, CASE WHEN a.relation = b.relation AND a.relation IN ('IS_A', 'HAS_PART', 'CAUSES', 'LEADS_TO', 'BEFORE') THEN a.relation ELSE 'RELATED_TO' END AS relation,
 CAST(0.6 AS DOUBLE) AS confidence, n.node_seq, a.adj_seq AS s1, b.adj_seq AS s2 FROM pr a JOIN pr b ON a.dst = b.src AND a.src <> b.dst JOIN nd n ON n.id = a.src WHERE NOT EXISTS (SELECT 1 FROM pr x WHERE x.src = a.src AND x.dst = b.dst))"""


@query(I.business("SELECT source, via, target, relation, confidence FROM a", f", {TWO_HOPS}"))
def j4_c11_inferred_all(spark: SparkSession, d: str) -> DataFrame:
    return reason.inferred(*I.business_graph(spark, d), scan=None, most=None)


@query(I.docs_graph("SELECT source, via, target, relation, confidence FROM a WHERE source IN (SELECT id FROM nd ORDER BY node_seq, id LIMIT 30) ORDER BY node_seq, source, s1, s2, via, target LIMIT 20").replace(" SELECT source, via", f", {TWO_HOPS} SELECT source, via", 1))
def j4_w6_inferred(spark: SparkSession, d: str) -> DataFrame:
    t = I.settle(I.doc_triples(spark, d))
    return reason.inferred(I.settle(G.nodes(t)), I.settle(G.edges(t)))


@query(I.business("SELECT source, via, target, relation, confidence FROM a WHERE source IN (SELECT id FROM nd ORDER BY node_seq, id LIMIT 30) ORDER BY node_seq, source, s1, s2, via, target LIMIT 20", f", {TWO_HOPS}"))
def j4_w6_inferred_tables(spark: SparkSession, d: str) -> DataFrame:
    return reason.inferred(*I.business_graph(spark, d))


CONTRA = """SELECT a.src AS source, a.dst AS target, 'SIMILAR_TO' AS relation_1, 'DIFFERS_FROM' AS relation_2, CAST(0.9 AS DOUBLE) AS confidence FROM ed a JOIN ed b ON a.src = b.src AND a.dst = b.dst AND a.relation = 'SIMILAR_TO' AND b.relation = 'DIFFERS_FROM'"""


@query(I.contested(CONTRA))
def j6_c13_contradictions_all(spark: SparkSession, d: str) -> DataFrame:
    t = I.contested_triples(spark, d)
    return reason.contradictions(G.nodes(t), G.edges(t), scan=None, most=None)


@query(I.contested(f"SELECT c.* FROM ({CONTRA}) c JOIN nd ON nd.id = c.source JOIN pr ON pr.src = c.source AND pr.dst = c.target WHERE c.source IN (SELECT id FROM nd ORDER BY node_seq, id LIMIT 50) ORDER BY node_seq, c.source, adj_seq, c.target LIMIT 10"))
def w5_contradictions(spark: SparkSession, d: str) -> DataFrame:
    t = I.contested_triples(spark, d)
    return reason.contradictions(G.nodes(t), G.edges(t))


SIBLINGS = """sb AS (SELECT n.node_seq, a.src, a.dst AS x, b.dst AS y, a.adj_seq AS sx, b.adj_seq AS sy FROM pr a JOIN pr b ON a.src = b.src AND (a.adj_seq < b.adj_seq OR (a.adj_seq = b.adj_seq AND a.dst < b.dst)) JOIN nd n ON n.id = a.src
 WHERE NOT EXISTS (SELECT 1 FROM pr e WHERE (e.src = a.dst AND e.dst = b.dst) OR (e.src = b.dst AND e.dst = a.dst)))"""


@query(I.business("SELECT src, x, y FROM sb WHERE src IN (SELECT id FROM nd ORDER BY node_seq, id LIMIT 50)", f", {SIBLINGS}"))
def j5_sibling_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = reason.sibling_gaps(*I.business_graph(spark, d))
    return rows.select(c("related")[0].alias("src"), c("related")[1].alias("x"), c("related")[2].alias("y"))


GAPS = """,
  cf AS (SELECT component, min(node_seq) AS seq, arg_min(cc.id, node_seq) AS rep FROM cc JOIN nd USING (id) GROUP BY component),
  gp AS (SELECT 1 AS section, node_seq AS a, id AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, CASE degree WHEN 0 THEN 'isolated_concept' ELSE 'weakly_connected' END AS type, id AS related, CASE degree WHEN 0 THEN 0.8 ELSE 0.5 END AS severity FROM dg JOIN nd USING (id) WHERE degree <= 1
    UNION ALL SELECT 2, x.seq, '', y.seq, 0, 'disconnected_components', x.rep || '/' || y.rep, 0.9 FROM cf x JOIN cf y ON x.seq < y.seq
    UNION ALL SELECT 3, node_seq, src, sx, sy, 'missing_link', src || '/' || x || '/' || y, 0.4 FROM sb WHERE src IN (SELECT id FROM nd ORDER BY node_seq, id LIMIT 50))"""


@query(I.business("SELECT CAST(row_number() OVER (ORDER BY section, a, b, c, d, related) AS INTEGER) AS rank, type, related, CAST(severity AS DOUBLE) AS severity FROM gp ORDER BY rank LIMIT 20", f"{I.COMPONENTS}, {SIBLINGS}{GAPS}"))
def c12_w4_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _joined(reason.gaps(*I.business_graph(spark, d)), "related")


@query(_PART_TRIPLES + f"""{I.COMPONENTS}, {SIBLINGS}{GAPS} SELECT CAST(row_number() OVER (ORDER BY section, a, b, c, d, related) AS INTEGER) AS rank, type, related, CAST(severity AS DOUBLE) AS severity FROM gp ORDER BY rank LIMIT 20""")
def c12_sibling_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _joined(reason.gaps(*_parts(spark, d)), "related")


@query(I.business("""SELECT type, count(*) AS n, string_agg(related, '; ' ORDER BY rank) FILTER (WHERE i <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank) AS i FROM
(SELECT row_number() OVER (ORDER BY section, a, b, c, d, related) AS rank, type, related FROM gp ORDER BY rank LIMIT 20)) GROUP BY type""", f"{I.COMPONENTS}, {SIBLINGS}{GAPS}"))
def a18_gap_summary(spark: SparkSession, d: str) -> DataFrame:
    return reason.gap_summary(reason.gaps(*I.business_graph(spark, d)))


#: Threads around the ten most central nodes, kept in order if they share at most 0.8 with those before
#: (those along paths come in only where fewer than five have been found).
THREADS = BETWEENNESS + """,
  ct AS MATERIALIZED (SELECT id, betweenness, row_number() OVER (ORDER BY round(betweenness, 12) DESC, node_seq, id) AS ord FROM bw QUALIFY ord <= 10),
  l1 AS (SELECT ord, ed.dst FROM ct JOIN ed ON ed.src = ct.id),
  l2 AS (SELECT ord, ed.dst FROM (SELECT DISTINCT ord, dst FROM l1) x JOIN ed ON ed.src = x.dst),
  th AS MATERIALIZED (SELECT ord, id, betweenness AS importance, list_concat([id], list_sort(list(DISTINCT dst))) AS nodes, least(count(*), 20) AS n_edges
    FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) JOIN ct USING (ord) GROUP BY ord, id, betweenness),
  tn AS MATERIALIZED (SELECT ord, id, importance, list_concat([id], list_filter(nodes[2:], lambda x: x <> id)) AS nodes, n_edges, row_number() OVER (ORDER BY ord) AS i FROM th WHERE len(list_distinct(nodes)) >= 3),
  kp AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[][]) AS kept, false AS stays UNION ALL
    SELECT tn.i, CASE WHEN len(list_filter(kept, lambda k: len(list_intersect(k, nodes)) / greatest(len(k), len(nodes)) > 0.8)) > 0 THEN kept ELSE list_append(kept, nodes) END,
      len(list_filter(kept, lambda k: len(list_intersect(k, nodes)) / greatest(len(k), len(nodes)) > 0.8)) = 0 FROM kp JOIN tn ON tn.i = kp.i + 1)"""


@query(I.business("SELECT 'Thread: ' || id AS name, array_to_string(nodes, '/') AS nodes, CAST(n_edges AS INTEGER) AS n_edges, round(importance, 9) AS importance FROM tn JOIN kp USING (i) WHERE stays", THREADS))
def c9_c10_u4_threads(spark: SparkSession, d: str) -> DataFrame:
    t = reason.threads(*I.business_graph(spark, d))
    return t.select("name", F.array_join("nodes", "/").alias("nodes"), F.size("edges").alias("n_edges"), F.round("importance", 9).alias("importance"))


@query(I.business("""SELECT concept, CAST(priority AS DOUBLE) AS priority, reasoning, difficulty FROM (
  SELECT concept, priority, reasoning, difficulty, section, o1, o2, row_number() OVER (PARTITION BY concept ORDER BY section, o1, o2) AS k FROM (
    SELECT dst AS concept, 0.8 AS priority, 'Directly related to asia via ' || relation AS reasoning, 'medium' AS difficulty, 1 AS section, adj_seq AS o1, 0 AS o2 FROM (SELECT *, row_number() OVER (ORDER BY adj_seq, dst) AS i FROM pr WHERE src = 'asia') WHERE i <= 5
    UNION ALL SELECT b.dst, 0.6, 'Related through ' || b.src, 'medium', 2, a.adj_seq, b.adj_seq FROM pr a JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY adj_seq, dst) AS i FROM pr) b ON b.src = a.dst WHERE a.src = 'asia' AND b.i <= 3 AND b.dst <> 'asia'
    UNION ALL SELECT src, 0.9, 'Prerequisite for understanding asia', 'easy', 3, adj_seq, 0 FROM (SELECT *, row_number() OVER (ORDER BY adj_seq, src) AS i FROM pr WHERE dst = 'asia') WHERE i <= 3)
  WHERE concept NOT IN ('nation_2')) WHERE k = 1 ORDER BY CASE WHEN contains(lower(concept), 'nation_1') THEN priority * 1.2 ELSE priority END DESC, section, o1, o2, concept LIMIT 5""").replace("SELECT concept, CAST(priority AS DOUBLE) AS priority, reasoning", "SELECT concept, CAST(CASE WHEN contains(lower(concept), 'nation_1') THEN priority * 1.2 ELSE priority END AS DOUBLE) AS priority, reasoning", 1))
def c15_c16_c17_topic(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("nation_2",)], "concept string")
    out = recommend.recommend(*I.business_graph(spark, d), topic="asia", known=known, interests=["NATION_1"])
    return out.withColumn("priority", F.round("priority", 9))


@query(I.business("SELECT id AS concept, round(r, 6) AS priority, 'medium' AS difficulty FROM pk JOIN pl USING (i) JOIN nd USING (id) ORDER BY round(r, 12) DESC, node_seq LIMIT 10", SETTLED))
def c17_w9_important(spark: SparkSession, d: str) -> DataFrame:
    return recommend.important(*I.business_graph(spark, d)).select("concept", F.round("priority", 6).alias("priority"), "difficulty")


@query(I.business("SELECT nd.id AS concept, round(degree / (SELECT max(degree) FROM dg), 6) AS priority FROM nd JOIN dg USING (id) ORDER BY degree DESC, node_seq, nd.id LIMIT 10"))
def c8_important_by_degree(spark: SparkSession, d: str) -> DataFrame:
    return recommend.important(*I.business_graph(spark, d), by="degree").select("concept", F.round("priority", 6).alias("priority"))


@query(I.business("""SELECT CAST(step AS INTEGER) AS step, concept, priority, difficulty FROM (SELECT 1 AS step, src AS concept, CAST(1.0 AS DOUBLE) AS priority, 'easy' AS difficulty FROM pr WHERE dst = 'nation_7'
UNION ALL SELECT 2, 'nation_7', round(1.0 - 1.0 / 3, 6), 'medium' UNION ALL SELECT 3, 'supplier000000', round(1.0 - 2.0 / 3, 6), 'hard') WHERE false"""))
def c18_learning_path_unknown(spark: SparkSession, d: str) -> DataFrame:
    out = recommend.learning_path(*I.business_graph(spark, d), goal="no such goal")
    return out.select("step", "concept", "priority", "difficulty")


@query(I.business("""SELECT CAST(i AS INTEGER) AS step, p[i] AS concept, round(1.0 - (i - 1) / 3.0, 6) AS priority, CASE i WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' ELSE 'hard' END AS difficulty, CAST(3 AS INTEGER) AS total, '1.5 hours' AS estimated_time
FROM (SELECT p, unnest([1, 2, 3]) AS i FROM (SELECT [a.src, a.dst, b.dst] AS p FROM pr a JOIN pr b ON a.dst = b.src WHERE b.dst = 'supplier000000003'))"""))
def c18_learning_path(spark: SparkSession, d: str) -> DataFrame:
    out = recommend.learning_path(*I.business_graph(spark, d), goal="Supplier000000003")
    return out.select("step", "concept", F.round("priority", 6).alias("priority"), "difficulty", "total", "estimated_time")


@query(I.business("SELECT src AS concept, 'Prerequisite for ' || dst || ' but not yet mastered' AS reasoning FROM pr WHERE dst IN ('nation_3', 'nation_4', 'click') AND src NOT IN ('nation_3', 'nation_4', 'click') ORDER BY dst, adj_seq, src LIMIT 5"))
def j10_weak_areas(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("nation_3",), ("nation_4",), ("click",)], "concept string")
    return recommend.weak_areas(I.business_graph(spark, d)[1], known)


@query("SELECT DISTINCT concept FROM (SELECT r_name AS concept FROM region UNION ALL SELECT p_type FROM part)")
def c19_profile_update(spark: SparkSession, d: str) -> DataFrame:
    return recommend.learn(table(spark, d, "region").select(c("r_name").alias("concept")), table(spark, d, "part").select(c("p_type").alias("concept")))
