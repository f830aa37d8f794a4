"""Queries over entities, vectors and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import cells, evaluate, link, retrieve
from loomgraph.operators import graph as G
from loomgraph.plans import inputs as I
from loomgraph.plans.registry import ORACLES, query, table

c = F.col
#: Threshold for the driver's vectors, whose largest similarity is far below that of real text.
COSINE = 0.3
#: Components of the hashed vectors of names: many, so that few 3-grams share one.
NAMES = 1 << 20


@query(f"""WITH {I.TRIPLES}, e AS (SELECT subject AS name, triple_seq * 2 AS seq FROM tr UNION ALL SELECT object, triple_seq * 2 + 1 FROM tr) SELECT name, count(*) AS mentions, min(seq) AS seq FROM e GROUP BY name""")
def a7_entities(spark: SparkSession, d: str) -> DataFrame:
    return link.entities(I.doc_triples(spark, d))


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    """Entities grouped by their first four letters, as a stand-in for vectors."""
    return link.entities(I.doc_triples(spark, d)).withColumn("cluster", F.lower(F.substring("name", 1, 4)))


_CLUSTERED = f"""WITH {I.TRIPLES}, e AS (SELECT subject AS name, triple_seq * 2 AS seq FROM tr UNION ALL SELECT object, triple_seq * 2 + 1 FROM tr),
 en AS (SELECT name, count(*) AS mentions, min(seq) AS seq FROM e GROUP BY name), cl AS (SELECT *, lower(name[:4]) AS cluster, row_number() OVER (PARTITION BY lower(name[:4]) ORDER BY mentions DESC, length(name) DESC, seq) AS k FROM en),
 ca AS (SELECT a.name, b.name AS canonical, a.cluster, a.mentions FROM cl a JOIN cl b ON a.cluster = b.cluster AND b.k = 1)"""


@query(_CLUSTERED + " SELECT name, canonical FROM ca")
def a8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return link.canonical(I.settle(_clustered(spark, d)))


@query(_CLUSTERED + " SELECT cluster, canonical, md5(string_agg(name, '/' ORDER BY name)) AS aliases, CAST(sum(mentions) AS BIGINT) AS mentions FROM ca GROUP BY cluster, canonical")
def a9_merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    return link.merge_clusters(_clustered(spark, d)).withColumn("aliases", F.md5(F.array_join("aliases", "/")))


@query(_CLUSTERED + """, re AS (SELECT triple_seq, coalesce(a.canonical, subject) AS subject, relation, coalesce(b.canonical, object) AS object FROM tr LEFT JOIN ca a ON a.name = subject LEFT JOIN ca b ON b.name = object)
 SELECT triple_seq, subject, relation, object FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, object ORDER BY triple_seq) AS k FROM re WHERE subject <> object) WHERE k = 1""")
def j7_w3_p5_relinked(spark: SparkSession, d: str) -> DataFrame:
    t = I.settle(I.doc_triples(spark, d))
    mapping = link.canonical(link.entities(t).withColumn("cluster", F.lower(F.substring("name", 1, 4))))
    return link.relink(t, mapping).select("triple_seq", "subject", "relation", "object")


def _vectors(names: str) -> str:
    """(name, term, w): hashed 3-grams of names, as the entity vectors count them."""
    mixed = f"SELECT name, c1, c2, c3, CAST(xor(h, h >> 29) AS UBIGINT) AS h FROM (SELECT name, c1, c2, c3, CAST(CAST(xor(h, CAST({{0}} AS UBIGINT)) AS UHUGEINT) * 11400714819323198485 % 18446744073709551616 AS UBIGINT) AS h FROM ({{1}}))"
    each = f"SELECT name, unicode(p[i:i]) AS c1, unicode(p[i + 1:i + 1]) AS c2, unicode(p[i + 2:i + 2]) AS c3, CAST(0 AS UBIGINT) AS h FROM (SELECT name, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT name, '  ' || lower(name) || ' ' AS p FROM {names}))"
    for c_ in ("c1", "c2", "c3"):
        each = mixed.format(c_, each)
    return f"SELECT name, CAST((h >> 1) % {NAMES} AS BIGINT) AS term, CAST(sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS w FROM ({each}) GROUP BY ALL HAVING sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) <> 0"


def _average(ids: str, pairs: str, distance: float) -> str:
    """st (n, id, cl): clusters after n rounds of merging those nearest to each
    other; ``pairs`` (a, b, cosine) has both orders and all pairs that may merge."""
    sizes = "(SELECT cl, count(*) AS k FROM st GROUP BY cl)"
    near = f"""SELECT x, y, round(1 - sum(cosine) / (any_value(nx) * any_value(ny)), 9) AS d FROM (
        SELECT sa.cl AS x, sb.cl AS y, zx.k AS nx, zy.k AS ny, cosine FROM {pairs} JOIN st sa ON sa.id = a JOIN st sb ON sb.id = b JOIN {sizes} zx ON zx.cl = sa.cl JOIN {sizes} zy ON zy.cl = sb.cl WHERE sa.cl <> sb.cl) GROUP BY x, y"""
    return f"""st AS (SELECT 0 AS n, id, id AS cl FROM {ids} UNION ALL SELECT st.n + 1, st.id, coalesce(mv.lo, st.cl) FROM st LEFT JOIN (
      SELECT least(x, y) AS lo, greatest(x, y) AS hi FROM (SELECT x, arg_min(y, (d, y)) AS y FROM ({near}) WHERE d < {distance!r} GROUP BY x) GROUP BY ALL HAVING count(*) = 2) mv ON mv.hi = st.cl
      WHERE EXISTS (SELECT 1 FROM ({near}) WHERE d < {distance!r}))"""


def _linked(known: str, similarity: float = 0.85) -> str:
    """kn: names of the triples that ``known`` holds for; ca: their clusters and canonical names; ve, le: vectors and their squared lengths of all names."""
    return f"""WITH RECURSIVE {I.TRIPLES}, e AS (SELECT doc_id, subject AS name, triple_seq * 2 AS seq FROM tr UNION ALL SELECT doc_id, object, triple_seq * 2 + 1 FROM tr),
     kn AS MATERIALIZED (SELECT name, count(*) AS mentions, min(seq) AS seq FROM e WHERE {known} AND length(name) > 0 GROUP BY name), al AS MATERIALIZED (SELECT name, CAST(row_number() OVER () AS INTEGER) AS k FROM (SELECT DISTINCT name FROM e WHERE length(name) > 0)),
     ve AS MATERIALIZED (SELECT v.*, k FROM ({_vectors('al')}) v JOIN al USING (name)), le AS MATERIALIZED (SELECT name, k, CAST(sum(w * w) AS DOUBLE) AS n2 FROM ve GROUP BY name, k), vk AS MATERIALIZED (SELECT * FROM ve SEMI JOIN kn USING (name)),
     ed AS MATERIALIZED (SELECT x.name AS a, y.name AS b FROM (SELECT p.k AS a, q.k AS b, sum(CAST(p.w * q.w AS INTEGER)) AS dot FROM vk p JOIN vk q ON p.term = q.term AND p.k < q.k GROUP BY ALL) JOIN le x ON x.k = a JOIN le y ON y.k = b WHERE dot / sqrt(x.n2 * y.n2) > {similarity}),
     sy AS MATERIALIZED (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), rc AS (SELECT DISTINCT a AS id, a AS hit FROM sy UNION SELECT rc.id, sy.b FROM rc JOIN sy ON sy.a = rc.hit), co AS MATERIALIZED (SELECT id, min(hit) AS component FROM rc GROUP BY id),
     pc AS MATERIALIZED (SELECT a, b, coalesce(dot, 0) / sqrt(x.n2 * y.n2) AS cosine FROM (SELECT p.id AS a, q.id AS b FROM co p JOIN co q ON p.component = q.component AND p.id <> q.id)
       LEFT JOIN (SELECT p.name AS a, q.name AS b, sum(p.w * q.w) AS dot FROM vk p JOIN co i ON i.id = p.name JOIN co j ON j.component = i.component AND j.id <> i.id JOIN vk q ON q.name = j.id AND q.term = p.term GROUP BY ALL) USING (a, b) JOIN le x ON x.name = a JOIN le y ON y.name = b),
     {_average('co', 'pc', 1 - similarity)},
     cl AS (SELECT kn.*, coalesce(cl, name) AS cluster FROM kn LEFT JOIN (SELECT id, cl FROM st WHERE n = (SELECT max(n) FROM st)) ON id = name),
     ca AS MATERIALIZED (SELECT name, cluster, mentions, first_value(name) OVER (PARTITION BY cluster ORDER BY mentions DESC, length(name) DESC, seq) AS canonical FROM cl)"""


@query(_linked("doc_id % 2 = 0") + """, vo AS MATERIALIZED (SELECT * FROM ve ANTI JOIN kn USING (name)), nr AS MATERIALIZED (SELECT name, arg_min(other, (-cosine, other)) AS other FROM (SELECT x.name AS name, y.name AS other, dot / sqrt(x.n2 * y.n2) AS cosine FROM (
       SELECT p.k AS a, q.k AS b, sum(CAST(p.w * q.w AS INTEGER)) AS dot FROM vo p JOIN vk q ON p.term = q.term GROUP BY ALL) JOIN le x ON x.k = a JOIN le y ON y.k = b) WHERE cosine >= 0.85 GROUP BY name),
     mp AS (SELECT name, canonical FROM ca UNION ALL SELECT nr.name, canonical FROM nr JOIN ca ON ca.name = nr.other),
     re AS (SELECT triple_seq, coalesce(a.canonical, subject) AS subject, relation, coalesce(b.canonical, object) AS object FROM tr LEFT JOIN mp a ON a.name = subject LEFT JOIN mp b ON b.name = object)
     SELECT triple_seq, subject, relation, object FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, object ORDER BY triple_seq) AS k FROM re WHERE subject <> object) WHERE k = 1""")
def c20_j7_linked(spark: SparkSession, d: str) -> DataFrame:
    """The whole of entity linking: the names of half of the documents are encoded and clustered, those of the others go to the nearest."""
    t = I.settle(I.doc_triples(spark, d))
    return link.link(t, known=t.where("doc_id % 2 = 0"), dimension=NAMES).select("triple_seq", "subject", "relation", "object")


@query(_linked("true") + """ SELECT cluster, canonical, count(*) AS names, md5(string_agg(name, '/' ORDER BY name)) AS aliases, CAST(sum(mentions) AS BIGINT) AS mentions FROM ca GROUP BY cluster, canonical""")
def c23_a9_linked_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All names clustered by their vectors, each cluster folded into one row."""
    named = link.cluster(I.settle(link.entities(I.doc_triples(spark, d))), dimension=NAMES)
    folded = link.merge_clusters(I.settle(named))
    return folded.select("cluster", "canonical", F.size("aliases").cast("long").alias("names"), F.md5(F.array_join("aliases", "/")).alias("aliases"), "mentions")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_NEAR = f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {COSINE}"


@query(f"SELECT a, b, round(cosine, 6) AS cosine FROM ({_NEAR})")
def j8_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return link.similar_pairs(I.vectors(spark, d), COSINE).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_NEAR}), s AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT DISTINCT a AS id, a AS hit FROM s UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.hit),
 g AS (SELECT id, min(hit) AS cluster FROM r GROUP BY id) SELECT vec_id AS id, coalesce(cluster, -1) AS cluster FROM embeddings LEFT JOIN g ON g.id = vec_id""")
def c22_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return link.dbscan(I.vectors(spark, d), 1 - COSINE, 2)


@query(f"""WITH RECURSIVE x AS (SELECT vec_id AS id FROM embeddings), pc AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 {_average('x', 'pc', 1 - COSINE)} SELECT id, cl AS cluster, 'average' AS linkage FROM st WHERE n = (SELECT max(n) FROM st)""")
def c21_agglomerative(spark: SparkSession, d: str) -> DataFrame:
    return link.agglomerative(I.vectors(spark, d).select("id", "vec"), 1 - COSINE)


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_NEAR}), s AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT vec_id AS id, vec_id AS hit FROM embeddings UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.hit),
 g AS (SELECT id, min(hit) AS cluster FROM r GROUP BY id), z AS (SELECT cluster, count(*) AS n FROM g GROUP BY cluster)
 SELECT CAST(sum(n) AS BIGINT) AS total_entities, count(*) AS num_clusters, round(avg(n), 6) AS avg_cluster_size, max(n) AS max_cluster_size, count(*) FILTER (WHERE n = 1) AS singletons FROM z""")
def a10_link_statistics(spark: SparkSession, d: str) -> DataFrame:
    return link.link_statistics(link.dbscan(I.vectors(spark, d), 1 - COSINE, 2)).withColumn("avg_cluster_size", F.round("avg_cluster_size", 6))


@query(f"""SELECT id, match FROM (SELECT u.vec_id AS id, k.vec_id AS match, row_number() OVER (PARTITION BY u.vec_id ORDER BY {_COS.replace('a.', 'u.').replace('b.', 'k.')} DESC, k.vec_id) AS n
 FROM (SELECT * FROM embeddings WHERE label < 5) u JOIN (SELECT * FROM embeddings WHERE label >= 5) k ON {_COS.replace('a.', 'u.').replace('b.', 'k.')} >= {COSINE}) WHERE n = 1""")
def j7_nearest_entity(spark: SparkSession, d: str) -> DataFrame:
    v = I.vectors(spark, d)
    return link.nearest(v.where("label < 5").select("id", "vec"), v.where("label >= 5").select("id", "vec"), COSINE)


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Returned lines as predictions, discounted lines as gold."""
    t = table(spark, d, "lineitem").select(F.concat(F.lit(" Supplier "), c("l_suppkey").cast("string")).alias("subject"), F.lit("sells").alias("relation"), F.concat(F.lit("PART "), c("l_partkey").cast("string")).alias("object"), "l_returnflag", "l_discount")
    return t.where("l_returnflag = 'R'"), t.where("l_discount > 0.05")


_GOLD = """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.05),
 n AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)"""


@query(_GOLD + " SELECT tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2.0 * tp / (np + ng), 6) AS f1, round(tp / (np + ng - tp), 6) AS agreement FROM n")
def a11_a13_j12_compare(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.compare(*_gold(spark, d))
    for x in ("precision", "recall", "f1", "agreement"):
        out = out.withColumn(x, F.round(x, 6))
    return out


@query("SELECT DISTINCT 'supplier ' || l_suppkey AS subject, 'SELLS' AS relation, 'part ' || l_partkey AS object FROM lineitem WHERE l_returnflag = 'R'")
def f22_u2_triple_set(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.triple_set(_gold(spark, d)[0])


@query(I.business("""SELECT unique_entities, total_triples, total_relations, round(total_triples / (unique_entities * (unique_entities - 1.0)), 6) AS graph_density, round(avg_node_degree, 6) AS avg_node_degree, round(largest / unique_entities, 6) AS connectivity, round(covered / unique_entities, 6) AS coverage,
 CAST(1.0 AS DOUBLE) AS avg_confidence, CAST(1.0 AS DOUBLE) AS high_confidence_ratio, round(tp / np, 6) AS precision, CAST(1.0 AS DOUBLE) AS recall, round(2.0 * tp / (np + tp), 6) AS f1, round(tp / np, 6) AS agreement
 FROM (SELECT count(*) AS unique_entities, avg(degree) AS avg_node_degree, count(*) FILTER (WHERE degree > 0) AS covered FROM dg), (SELECT count(*) AS total_triples, count(DISTINCT relation) AS total_relations FROM ed),
 (SELECT max(s) AS largest FROM (SELECT count(*) AS s FROM cc GROUP BY component)), (SELECT count(*) AS np, count(*) FILTER (WHERE relation <> 'LEADS_TO') AS tp FROM (SELECT DISTINCT src, upper(relation) AS relation, dst FROM tv))""", I.COMPONENTS))
def a14_full_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All triples against those of the tables' keys."""
    t = I.settle(I.business_triples(spark, d))
    gold = t.where("relation != 'LEADS_TO'").select("subject", "relation", "object")
    out = evaluate.full_evaluation(t, gold, I.settle(G.nodes(t)), I.settle(G.edges(t)))
    for x in ("graph_density", "avg_node_degree", "connectivity", "coverage", "precision", "recall", "f1", "agreement"):
        out = out.withColumn(x, F.round(x, 6))
    return out


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the smallest id of each label ask."""
    v = I.vectors(spark, d)
    return v.groupBy(c("label").alias("query_id")).agg(F.min_by("vec", "id").alias("qvec"))


_ASK = "q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qvec FROM embeddings GROUP BY label)"
_L2 = "1 - list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(qvec AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"WITH {_ASK}, s AS (SELECT query_id, vec_id AS id, {_L2} AS score FROM embeddings, q) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def c24_w12_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.search_blocks(I.vectors(spark, d), _queries(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_ASK}, s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qvec AS DOUBLE[])) AS score FROM embeddings, q WHERE label >= 2) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5 AND score >= 0.25")
def p6_p7_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.retrieve(I.vectors(spark, d), _queries(spark, d), 5, 0.25, "cosine", c("label") >= 2).withColumn("score", F.round("score", 6))


@query(ORACLES["c24_w12_search"])
def c24_cell_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search through an index of cells."""
    return cells.search(cells.build(I.vectors(spark, d)), _queries(spark, d)).withColumn("score", F.round("score", 6))


@query(ORACLES["p6_p7_retrieve"])
def p7_cell_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The same retrieval through an index of cells, whose cells are chosen by the rows that the filter leaves."""
    index = cells.build(I.vectors(spark, d), metric="cosine")
    return cells.search(index, _queries(spark, d), 5, c("label") >= 2, 0.25).withColumn("score", F.round("score", 6))


@query(f"WITH {I.CHUNKS} SELECT doc_id, chunk_index, total_chunks, md5(chunk) AS text FROM ch WHERE chunk <> ''")
def c25_index_rows(spark: SparkSession, d: str) -> DataFrame:
    from loomgraph.functions import text as T

    t = T.clean(c("text"))
    rows = table(spark, d, "documents").select("doc_id", t.alias("content"), T.fixed_chunks(t).alias("chunks"))
    return retrieve.index_rows(rows).withColumn("text", F.md5("text"))


@query()
def c20_c26_answers(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items ask the documents' chunks."""
    index = I.settle(retrieve.build_index(I.doc_chunks(spark, d).withColumnRenamed("chunk", "text"), 64))
    asked = I.settle(table(spark, d, "benchmark").select(c("item_id").alias("query_id"), retrieve.encode(c("text"), 64).alias("qvec")))
    hits = retrieve.retrieve(index, asked, 5, 0.0, "cosine").join(index.select("id", "text"), "id")
    return retrieve.answer(hits)


@query("SELECT count(*) AS total_documents, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings")
def a16_index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.index_statistics(I.vectors(spark, d))


@query(I.docs_graph(f"""SELECT source AS query_id, concept, id, coalesce(near, '') AS neighbours FROM
 (SELECT source, concept, {I.node_sql('concept')} AS id FROM (SELECT source, concept, row_number() OVER (PARTITION BY source ORDER BY concept) AS i FROM
   (SELECT DISTINCT source, unnest(list_filter(string_split({I.clean_sql('text')}, ' '), lambda x: length(x) > 4 AND regexp_matches(x, '^\\p{{Lu}}'))) AS concept FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3)) WHERE i <= 5)
 JOIN (SELECT id FROM nd) USING (id) LEFT JOIN (SELECT src, string_agg(dst, '/' ORDER BY i) AS near FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY adj_seq, dst) AS i FROM pr) WHERE i <= 3 GROUP BY src) ON src = id"""))
def j11_f20_context(spark: SparkSession, d: str) -> DataFrame:
    """Concepts named in the first texts of each source, with graph neighbours."""
    t = I.settle(I.doc_triples(spark, d))
    rank = F.row_number().over(I.Window.partitionBy("source").orderBy("doc_id"))
    results = table(spark, d, "documents").select(c("source").alias("query_id"), "text", rank.alias("rank"))
    out = retrieve.context(results, G.nodes(t), I.settle(G.edges(t)))
    return out.withColumn("neighbours", F.array_join("neighbours", "/"))
