"""Capture logs of saved pages and videos: validation, rendering, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def validate_pages(rows: DataFrame) -> DataFrame:
    """Page captures with ``error`` (null if fine) and defaults filled in; url
    and title are required."""
    lacking = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "missing url").when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing title")
    out = rows.withColumn("error", lacking)
    defaults = {"type": "article", "domain": "", "author": "", "publishDate": "", "content": ""}
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    words = F.when(F.length(F.trim("content")) > 0, F.size(F.split(F.trim("content"), T.SPACE + "+"))).otherwise(0)
    return out.withColumn("wordCount", words.cast("long"))


def validate_videos(rows: DataFrame) -> DataFrame:
    """Video captures with ``error``; id and url are required."""
    lacking = F.when(F.coalesce("videoId", F.lit("")) == "", "missing videoId").when(F.coalesce("url", F.lit("")) == "", "missing url")
    return rows.withColumn("error", lacking).withColumn("title", F.coalesce("title", F.concat(F.lit("Video "), "videoId")))


def render_page(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(filename, markdown) of valid page captures, and the columns ``keep``."""
    body = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("**Source:** "), "url"), F.concat(F.lit("**Type:** "), "type"), F.lit(""), F.lit("## Full Content"), F.lit(""), F.col("content"))
    return rows.where("error IS NULL").select(*keep, F.concat(T.safe_filename(F.col("title")), F.lit(".md")).alias("filename"), body.alias("markdown"))


def render_video(rows: DataFrame) -> DataFrame:
    """(filename, markdown) of videos (videoId, url, title, seconds, views, uploaded, transcript)."""
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("**Source:** "), "url"), F.concat(F.lit("**Duration:** "), T.duration_label(F.col("seconds"))),
        F.concat(F.lit("**Views:** "), T.thousands(F.col("views"))), F.concat(F.lit("**Uploaded:** "), T.upload_date(F.col("uploaded"))), F.lit(""), F.lit("## Transcript"), F.lit(""), F.coalesce("transcript", F.lit("")),
    )
    return rows.select(F.concat(T.safe_filename(F.col("title")), F.lit(".md")).alias("filename"), body.alias("markdown"))


def videos_of(video_log: DataFrame, page_log: DataFrame) -> DataFrame:
    """Distinct valid video links of both logs, with their ids."""
    pages = page_log.where(F.col("type") == "video").select("url")
    return video_log.select("url").unionByName(pages).where(T.is_video_url(F.col("url"))).distinct().withColumn("video_id", T.video_id(F.col("url")))


def pdfs_of(page_log: DataFrame) -> DataFrame:
    return page_log.where(F.col("type") == "pdf")


def last_rows(rows: DataFrame, seq: str, most: int = 10) -> DataFrame:
    """The last ``most`` rows, oldest first."""
    few = rows.orderBy(F.desc(seq)).limit(most)
    return few.withColumn("pos", F.row_number().over(Window.orderBy(seq)))  # over at most ``most`` rows


def capture_statistics(video_log: DataFrame, page_log: DataFrame) -> DataFrame:
    v, p = video_log.agg(F.count(F.lit(1)).alias("total_videos")), page_log.agg(F.count(F.lit(1)).alias("total_pages"))
    return v.crossJoin(p).withColumn("total", F.col("total_videos") + F.col("total_pages"))  # one row each


def url_parts(rows: DataFrame) -> DataFrame:
    """(page_id, domain, path, title) of web pages (page_id, url, html)."""
    return rows.select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("domain"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
    )
