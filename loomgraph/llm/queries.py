"""The corpus operators as queries over the driver tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import centroids, decontaminate, hard_negatives, langid, media, mixing, ngram_join, packing, quality, sharding, substring, token_count, topk_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=8)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10).drop("items")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), every=50, positives=5, negatives=3, window=(50, 95))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3).drop("centroid")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Words of a whole text, upper-case ASCII letters folded.
_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_ALNUM = _FOLDED.replace("[^\\x20\\x09-\\x0D]+", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")

ORACLES: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_decontamination": f"""
        WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
        i AS MATERIALIZED (SELECT item, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
        d AS (SELECT r, l, k, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM w, (SELECT DISTINCT l FROM i) WHERE len(w) >= l)),
        h AS MATERIALIZED (SELECT DISTINCT r, k, l, item FROM d JOIN i USING (l, g)),
        p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS p FROM h) GROUP BY r),
        q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN p USING (r) LEFT JOIN q USING (r)""",
    "op12_hard_negatives": """
        WITH v AS MATERIALIZED (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
          SELECT q.vec_id AS a, c.vec_id AS c, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), p AS (SELECT a, c, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS n FROM s WHERE same) WHERE n <= 5),
        r AS (SELECT p.a, p.c, p.score AS ps, s.c AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT a AS anchor_id, c AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM r WHERE rank <= 3""",
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
        s AS MATERIALIZED (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        u AS (SELECT doc_id, unnest(s) AS g FROM s),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * o >= 75 * (len(a.s) + len(b.s) - o)),
        e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.at)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.at) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM d),
        k AS (SELECT w.doc_id, count(c.p) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL), '') AS kept
          FROM w LEFT JOIN (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) x ON x.doc_id = w.doc_id
          LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY w.doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, n_removed, sha256(kept) AS kept_sha256 FROM w JOIN k ON k.doc_id = w.doc_id""",
}


def _rounds() -> str:
    """Rounds 1 to 10 of the clustering: nearest centroids, then their means."""
    near = "SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, sum((x - c) * (x - c)) AS d FROM e JOIN c{0} USING (i) GROUP BY r, j) GROUP BY r"
    mean = "SELECT j, i, CAST(coalesce((s - ((s % n) + n) % n) // n, c) AS BIGINT) AS c FROM c{0} LEFT JOIN (SELECT j, i, sum(x) AS s, count(*) AS n FROM e JOIN a{0} USING (r) GROUP BY j, i) USING (j, i)"
    return ",\n".join(f"a{n} AS MATERIALIZED ({near.format(n)})" + (f", c{n + 1} AS MATERIALIZED ({mean.format(n)})" if n < 10 else "") for n in range(11))


ORACLES["op13_centroid_clustering"] = f"""
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), e AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v),
        s AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS j FROM v WHERE vec_id IS NOT NULL),
        c0 AS MATERIALIZED (SELECT j, unnest(range(1, 65)) AS i, unnest(v) AS c FROM s WHERE j < 8),
        {_rounds()},
        h AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c10 GROUP BY j),
        t AS (SELECT j, sum(d) AS own FROM a10 GROUP BY j)
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a10) AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a10 JOIN v USING (r) JOIN t USING (j) JOIN h USING (j)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (
        op1_topk_search, op2_ngram_join, op3_sharding, op4_mixing, op5_media, op6_token_count, op7_substring_dedup, op8_packing, op9_quality, op10_language_id, op11_decontamination, op12_hard_negatives, op13_centroid_clustering, pipeline,
    )}
    return out


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
