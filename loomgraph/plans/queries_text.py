"""Queries over text: scalar functions, chunks, extraction, datasets, captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.chunking import SENTENCE_ENDS
from loomgraph.operators import capture, dataset, extract
from loomgraph.plans import inputs as I
from loomgraph.plans.registry import query, table
from loomgraph.sources import sinks

SPACE, c = T.SPACE, F.col


@query(f"SELECT doc_id, md5({I.clean_sql('text')}) AS cleaned, CAST(length({I.clean_sql('text')}) AS INTEGER) AS n FROM documents")
def f1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.clean(c("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("cleaned"), F.length(t).alias("n"))


@query(f"SELECT doc_id, md5(trim(replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), chr(0), ''))) AS cleaned FROM documents")
def f2_clean_text_late(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_late(c("text"))).alias("cleaned"))


@query(f"WITH {I.CHUNKS} SELECT doc_id, chunk_index, total_chunks, md5(chunk) AS chunk, CAST(length(chunk) AS INTEGER) AS n FROM ch")
def f3_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_chunks(spark, d).select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("chunk"), F.length("chunk").alias("n"))


def _reach_sql(w: str, marks: tuple[str, ...] = SENTENCE_ENDS[:3]) -> str:
    """How far the window ``w`` reaches: after the last of the first kind of mark in it, if that moves the start on.
    Cleaned texts have no line ends."""
    if not marks:
        return "512"
    back = f"strpos(reverse({w}), '{marks[0][::-1]}')"
    return f"CASE WHEN {back} = 0 THEN {_reach_sql(w, marks[1:])} WHEN 513 - {back} > 50 THEN 513 - {back} ELSE 512 END"


@query(f"""WITH RECURSIVE dt AS MATERIALIZED (SELECT doc_id, {I.clean_sql('text')} AS t, length({I.clean_sql('text')}) AS n FROM documents WHERE text IS NOT NULL),
 sw AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST(CASE WHEN n <= 512 THEN n ELSE {_reach_sql('t[1:512]')} END AS BIGINT) AS e FROM dt
  UNION ALL SELECT doc_id, a, CASE WHEN a + 512 < n THEN a + {_reach_sql('w')} ELSE a + 512 END FROM (SELECT doc_id, e - 50 AS a, n, substring(t, e - 49, 512) AS w FROM sw JOIN dt USING (doc_id) WHERE n > 512 AND e - 50 < n)),
 sc AS (SELECT doc_id, a, CASE WHEN n <= 512 THEN t ELSE trim(substring(t, a + 1, e - a)) END AS chunk, n FROM sw JOIN dt USING (doc_id))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, md5(chunk) AS chunk FROM sc WHERE chunk <> '' OR n <= 512""")
def f4_sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunks(table(spark, d, "documents"), "sentence").select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, list_slice(list_filter(list_transform(range(0, CAST(ceil(len(w) / 300.0) AS INT)), lambda i: w[i * 300 + 1:i * 300 + 300]), lambda x: len(x) > 50), 1, 10) AS k FROM w)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, md5(array_to_string(k[i], ' ')) AS chunk FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM k)""")
def f5_word_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return dataset.word_windows(rows).select("doc_id", "pos", F.md5("chunk").alias("chunk"))


@query("SELECT doc_id, md5(coalesce(string_split(text, '. ')[2], text)) AS part FROM documents WHERE text IS NOT NULL")
def f6_section(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.section(c("text"), ". ")).alias("part"))


@query(f"""SELECT p_partkey, {I.entity_sql("'the ' || p_name")} AS entity, replace(upper(trim(p_type)), ' ', '_') AS relation, {I.node_sql("p_name || ' (' || p_brand || ')'")} AS node_id,
CASE WHEN upper(p_type) IN {I.TYPES_SQL} THEN upper(p_type) ELSE 'RELATED_TO' END AS edge_type FROM part""")
def f7_f10_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", T.entity(F.concat(F.lit("the "), "p_name")).alias("entity"), T.relation(c("p_type")).alias("relation"),
        T.node_id(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("node_id"), T.edge_type(c("p_type")).alias("edge_type"),
    )


@query("""SELECT n_nationkey, 'S:' || r_name || '|R:HAS_PART|O:' || n_name AS line, r_name AS subject, 'HAS_PART' AS relation, n_name AS object FROM nation JOIN region ON r_regionkey = n_regionkey""")
def f11_triple_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), c("r_regionkey") == c("n_regionkey"))
    line = T.format_triple(c("r_name"), F.lit("HAS_PART"), c("n_name"))
    return rows.select("n_nationkey", line.alias("line"), T.parse_triple(line).alias("t")).select("n_nationkey", "line", "t.*")


@query("""WITH x AS (SELECT doc_id, string_split(string_split('Answer' || chr(10) || '### Output:' || chr(10) || 'S:' || source || '|R:HAS|O:' || lang || chr(10) || 'bad line' || chr(10) || 'S:only|R:two', '### Output:')[2], chr(10)) AS l FROM documents),
y AS (SELECT doc_id, string_split(z, '|') AS p FROM (SELECT doc_id, unnest(l) AS z FROM x) WHERE z LIKE 'S:%')
SELECT doc_id, trim(replace(p[1], 'S:', '')) AS subject, trim(replace(p[2], 'R:', '')) AS relation, trim(replace(p[3], 'O:', '')) AS object, CAST(0.9 AS DOUBLE) AS confidence FROM y WHERE len(p) >= 3""")
def f12_generated_triples(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Answer\n### Output:\nS:"), "source", F.lit("|R:HAS|O:"), "lang", F.lit("\nbad line\nS:only|R:two"))
    return table(spark, d, "documents").select("doc_id", F.inline(T.parse_generated(said)))


@query("""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' WHEN 1 THEN 'https://youtu.be/' WHEN 2 THEN 'https://www.youtube.com/embed/' ELSE url || '#' END || substr(md5(CAST(page_id AS VARCHAR)), 1, 11) AS u, url FROM pages)
SELECT page_id, CASE WHEN u LIKE '%youtu%' THEN right(u, 11) END AS video_id, u LIKE '%youtu%' AS valid FROM v""")
def f13_f14_video_ids(spark: SparkSession, d: str) -> DataFrame:
    kind = c("page_id") % 4
    base = F.when(kind == 0, "https://www.youtube.com/watch?v=").when(kind == 1, "https://youtu.be/").when(kind == 2, "https://www.youtube.com/embed/").otherwise(F.concat("url", F.lit("#")))
    u = F.concat(base, F.substring(F.md5(c("page_id").cast("string")), 1, 11))
    return table(spark, d, "pages").select("page_id", T.video_id(u).alias("video_id"), T.is_video_url(u).alias("valid"))


@query("""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS stamp,
CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration, format('{:,}', n) AS views, strftime(o_orderdate, '%Y-%m-%d') AS uploaded, 'soon' AS other FROM s""")
def f15_f17_times_and_dates(spark: SparkSession, d: str) -> DataFrame:
    s = F.floor(c("o_totalprice") / 10)
    return table(spark, d, "orders").select(
        "o_orderkey", T.timestamp_label(s).alias("stamp"), T.duration_label(s).alias("duration"), T.thousands(F.floor("o_totalprice")).alias("views"),
        T.upload_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("uploaded"), T.upload_date(F.lit("soon")).alias("other"),
    )


@query("""SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) FILTER (WHERE trim(coalesce(text, '')) <> '') AS text FROM conversations GROUP BY conv_id""")
def f18_subtitle_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array(F.struct(c("text").alias("utf8"))).alias("segs")))).alias("e"))
    return rows.select("conv_id", F.nullif(T.subtitle_text(c("e")), F.lit("")).alias("text"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 'None' AS gone, CAST(json_extract(props, '$.k') AS BIGINT) AS k_number FROM events""")
def f19_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("gone"), F.lit(None).cast("string")))
    kept = T.stringify_metadata(meta)
    return table(spark, d, "events").select("event_id", kept["k"].alias("k"), kept["gone"].alias("gone"), F.try_variant_get(T.sniff_metadata(kept)["k"], "$", "bigint").alias("k_number"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split({I.clean_sql('text')}, ' '), lambda x: length(x) > 4 AND regexp_matches(x, '^\\p{{Lu}}'))) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_sort(w), ' ')) AS words, CAST(len(w) AS INTEGER) AS n FROM w""")
def f20_concept_words(spark: SparkSession, d: str) -> DataFrame:
    w = T.concept_words(c("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.array_join(w, " ")).alias("words"), F.size(w).alias("n"))


@query("""SELECT doc_id, md5('### Instruction:' || chr(10) || 'Extract knowledge triples from the text.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Output:' || chr(10)) AS prompt FROM documents""")
def f23_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.prompt(F.lit(dataset.INSTRUCTION), c("text"))).alias("prompt"))


@query()
def f24_synthetic_examples(spark: SparkSession, d: str) -> DataFrame:
    return dataset.synthetic(spark, table(spark, d, "documents").count())


@query("""SELECT p_partkey, CASE WHEN p_size % 7 < 7 / 3.0 THEN 'easy' WHEN p_size % 7 < 14 / 3.0 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN p_size * 0.5 < 1 THEN CAST(CAST(p_size * 30 AS INT) AS VARCHAR) || ' minutes' ELSE printf('%.1f hours', p_size * 0.5) END AS needed FROM part""")
def f26_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.difficulty(c("p_size") % 7, F.lit(7)).alias("difficulty"), T.time_needed(c("p_size")).alias("needed"))


@query("""SELECT doc_id, 'a b' AS fm_title, source AS fm_source, lang AS fm_lang FROM documents""")
def s5_front_matter(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("---\ntitle: a b\nsource: x\nsource: "), "source", F.lit("\nno pair\nlang: "), "lang", F.lit("\n---\n"), "text")
    rows = table(spark, d, "documents").select("doc_id", T.front_matter(text).alias("m"))
    return rows.select("doc_id", c("m")["fm_title"].alias("fm_title"), c("m")["fm_source"].alias("fm_source"), c("m")["fm_lang"].alias("fm_lang"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, md5(k[i]) AS paragraph FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM
(SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p)), lambda p: length(p) > 100) AS k FROM documents))""")
def s17_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n\n")))
    return dataset.paragraphs(rows).select("doc_id", "pos", F.md5("paragraph").alias("paragraph"))


PAGE_LOG = "SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'video' ELSE 'article' END AS type FROM pages"


def _page_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(c("page_id") % 3 == 0, "pdf").when(c("page_id") % 3 == 1, "video").otherwise("article")
    return table(spark, d, "pages").select("page_id", "url", kind.alias("type"), "html")


@query(f"SELECT page_id, url, type FROM ({PAGE_LOG}) WHERE type = 'pdf'")
def s20_saved_pdfs(spark: SparkSession, d: str) -> DataFrame:
    return capture.pdfs_of(_page_log(spark, d)).select("page_id", "url", "type")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{L}\p{N} _-]', '_', 'g')[:100] || '.md' AS filename,
md5('# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || chr(10) || '**Source:** ' || url || chr(10) || '**Type:** article' || chr(10) || chr(10) || '## Full Content' || chr(10) || chr(10) || html) AS markdown
FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> ''""")
def s21_render_pages(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    rows = table(spark, d, "pages").select("page_id", "url", title.alias("title"), c("html").alias("content"))
    checked = capture.validate_pages(rows)
    return capture.render_page(checked, keep=("page_id",)).select("page_id", "filename", F.md5("markdown").alias("markdown"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'missing videoId' WHEN page_id % 7 = 0 THEN 'missing url' END AS error, CASE WHEN page_id % 2 = 0 THEN 'Kept ' || page_id WHEN page_id % 5 = 0 THEN 'Video ' ELSE 'Video v' || page_id END AS title FROM pages""")
def s22_saved_videos(spark: SparkSession, d: str) -> DataFrame:
    """Video captures, some of which lack their id, url or title."""
    text = c("page_id").cast("string")
    video, title = F.when(c("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("v"), text)), F.when(c("page_id") % 2 == 0, F.concat(F.lit("Kept "), text))
    rows = table(spark, d, "pages").select("page_id", video.alias("videoId"), F.when(c("page_id") % 7 != 0, c("url")).alias("url"), title.alias("title"))
    return capture.validate_videos(rows).select("page_id", "error", "title")


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def s21_url_parts(spark: SparkSession, d: str) -> DataFrame:
    return capture.url_parts(table(spark, d, "pages"))


@query("""SELECT count(*) AS total_documents, CAST(sum(n) AS BIGINT) AS total_chunks, string_agg(DISTINCT source, ',' ORDER BY source) AS source_files FROM (SELECT source, CASE WHEN length(t) <= 512 THEN 1 ELSE ceil(length(t) / 462.0) END AS n
FROM (SELECT source, """ + I.clean_sql("text") + """ AS t FROM documents))""")
def k1_ingestion_summary(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ingestion_summary(table(spark, d, "documents").select("source", T.fixed_chunks(T.clean(c("text"))).alias("chunks")))


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N} _-]', '_', 'g')[:100] AS filename FROM documents")
def k13_safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.safe_filename(c("text")).alias("filename"))


@query(f"WITH v AS (SELECT 'https://youtu.be/' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 11) AS url FROM conversations UNION ALL SELECT 'https://youtu.be/' || substr(md5(CAST(page_id AS VARCHAR)), 1, 11) FROM ({PAGE_LOG}) WHERE type = 'video') SELECT DISTINCT url, right(url, 11) AS video_id FROM v")
def u5_videos(spark: SparkSession, d: str) -> DataFrame:
    link = lambda x: F.concat(F.lit("https://youtu.be/"), F.substring(F.md5(c(x).cast("string")), 1, 11))
    log = _page_log(spark, d).withColumn("url", link("page_id"))
    return capture.videos_of(table(spark, d, "conversations").select(link("conv_id").alias("url")), log)


@query("SELECT (SELECT count(*) FROM conversations) AS total_videos, (SELECT count(*) FROM pages) AS total_pages, (SELECT count(*) FROM conversations) + (SELECT count(*) FROM pages) AS total")
def a17_capture_statistics(spark: SparkSession, d: str) -> DataFrame:
    return capture.capture_statistics(table(spark, d, "conversations"), table(spark, d, "pages"))


@query("SELECT page_id, url, CAST(row_number() OVER (ORDER BY page_id) AS INTEGER) AS pos FROM (SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 10)")
def w13_last_pages(spark: SparkSession, d: str) -> DataFrame:
    return capture.last_rows(table(spark, d, "pages").select("page_id", "url"), "page_id")


@query(f"WITH {I.TRIPLES} SELECT doc_id, chunk_index, triple_seq, subject, relation, object, confidence FROM tr")
def e1_e2_triples(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_triples(spark, d).select("doc_id", "chunk_index", "triple_seq", "subject", "relation", "object", "confidence")


@query(f"WITH {I.TRIPLES} SELECT relation, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tr GROUP BY relation ORDER BY n DESC, relation LIMIT 10")
def e2_top_relations(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_triples(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")).orderBy(F.desc("n"), "relation").limit(10)


#: A sentence for each of the other patterns, in terms of the parts table.
_SENTENCE = "{a} consists of {b}. {a} has {b}. {a} causes {b}. {a} leads to {b}. {a} results in {b}. {a} is used for {b}. {a} applies to {b}. {a} is similar to {b}. {a} differs from {b}. {a} comes before {b}. {a} comes after {b}. {a} is a kind of {b}. {a} are types of {b}."


@query(f"""WITH ch AS (SELECT p_partkey AS doc_id, CAST(0 AS INTEGER) AS chunk_index, replace(replace('{_SENTENCE}', '{{a}}', 'Part' || p_partkey), '{{b}}', p_type) AS chunk FROM part), {I.TRIPLES[len(I.CHUNKS) + 1:]}
SELECT doc_id, triple_seq, subject, relation, object FROM tr""")
def e1_all_patterns(spark: SparkSession, d: str) -> DataFrame:
    said = F.replace(F.replace(F.lit(_SENTENCE), F.lit("{a}"), F.concat(F.lit("Part"), c("p_partkey").cast("string"))), F.lit("{b}"), c("p_type"))
    rows = table(spark, d, "part").select(c("p_partkey").alias("doc_id"), F.lit(0).alias("chunk_index"), said.alias("chunk"))
    return I.short_seq(extract.triples(rows)).select("doc_id", "triple_seq", "subject", "relation", "object")


@query("""WITH e AS (SELECT l_orderkey AS s, l_linenumber AS p, 'part' || (l_partkey % 50) AS n FROM lineitem)
SELECT a.n AS subject, b.n AS object, count(*) AS n FROM e a JOIN e b ON a.s = b.s AND a.p < b.p AND a.n <> b.n GROUP BY a.n, b.n""")
def e4_j13_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("sentence_id"), c("l_linenumber").alias("pos"), F.concat(F.lit("part"), (c("l_partkey") % 50).cast("string")).alias("name"))
    return extract.cooccurrence(rows).groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {I.TRIPLES}, g AS (SELECT doc_id, chunk_index, count(*) AS k, string_agg('S:' || subject || '|R:' || relation || '|O:' || object, chr(10) ORDER BY triple_seq) AS o FROM tr GROUP BY ALL)
SELECT doc_id, chunk_index, md5(o) AS output FROM g WHERE k >= 2""")
def e6_p10_examples(spark: SparkSession, d: str) -> DataFrame:
    return dataset.examples(I.doc_chunks(spark, d), "documents").select("doc_id", "chunk_index", F.md5("output").alias("output"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def a15_count_sources(spark: SparkSession, d: str) -> DataFrame:
    return dataset.count_sources(table(spark, d, "documents"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r < CAST(floor(0.8 * n) AS BIGINT) THEN 'train' WHEN r < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r""")
def u6_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, text AS input, 'S:' || source || '|R:HAS|O:' || lang AS output, source FROM documents")
def s18_manual_annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("text", F.array(T.format_triple(c("source"), F.lit("HAS"), c("lang"))).alias("triples"), F.create_map(F.lit("source"), c("source"), F.lit("id"), c("doc_id").cast("string")).alias("metadata"))
    return dataset.manual(rows).select(c("metadata")["id"].cast("long").alias("doc_id"), "input", "output", c("metadata")["source"].alias("source"))


@query("""SELECT window_start, event_type, n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def x_windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(c("w.start").alias("window_start"), "event_type", "n")

