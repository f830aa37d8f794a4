"""Growing a graph from a landing folder of captures, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import text as T
from loomgraph.operators import extract
from loomgraph.operators import graph as G

LANDING = "url string, title string, content string, savedAt timestamp"


def captures(spark: SparkSession, folder: str, late: str = "1 day", files: int = 100) -> DataFrame:
    """Captures of a landing folder of JSON lines; an url that comes again
    within the allowed lateness is taken once."""
    rows = spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files).json(folder)
    return rows.where("url IS NOT NULL").withWatermark("savedAt", late).dropDuplicatesWithinWatermark(["url"])


def stream_triples(rows: DataFrame) -> DataFrame:
    """Triples of each capture: clean, chunk and match on the row, no state."""
    docs = rows.select(F.xxhash64("url").alias("doc_id"), F.col("content").alias("text"))
    return extract.triples(extract.chunks(docs))


def counts(rows: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Captures by time window and domain; late ones are dropped after the watermark."""
    domain = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return rows.groupBy(F.window("savedAt", window), domain.alias("domain")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "domain", "n")


def merge_into(folder: str):
    """Batch writer that merges a batch's graph into tables below ``folder``.

    Each batch goes to a new version and the pointer (the highest complete
    number) moves last, so a batch that is repeated after a failure gives the
    same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.persist()
        nodes, edges = G.nodes(found), G.edges(found)
        if number > 0:
            old = f"{folder}/v{number - 1}"
            nodes = G.upsert_nodes(spark.read.parquet(f"{old}/nodes"), nodes)
            edges = G.upsert_edges(spark.read.parquet(f"{old}/edges"), edges)
        nodes.write.mode("overwrite").parquet(f"{folder}/v{number}/nodes")
        edges.write.mode("overwrite").parquet(f"{folder}/v{number}/edges")
        found.unpersist()

    return write


def grow(spark: SparkSession, landing: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the stream from ``landing`` into versions below ``folder``; it
    takes what is there and ends."""
    found = stream_triples(captures(spark, landing))
    return found.writeStream.foreachBatch(merge_into(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the last version that the stream has committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in system.listStatus(path)]
    last = max(int(n) for n in done if n.isdigit())
    return spark.read.parquet(f"{folder}/v{last}/nodes"), spark.read.parquet(f"{folder}/v{last}/edges")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users (user_id, ts) that end after ``gap`` without an event."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def clean_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", T.clean(F.col("content")))
