"""Vector index, search and answers with graph context."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators.link import encode
from loomgraph.plans.iterate import settle


def index_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, text) to index from (doc_id,
    content, chunks): a row for each chunk, the whole content where there are
    none; empty content is left out."""
    full = docs.where(F.length(F.coalesce("content", F.lit(""))) > 0)
    parts = F.when(F.size(F.coalesce("chunks", F.array())) > 0, F.col("chunks")).otherwise(F.array("content"))
    return full.select("doc_id", F.size(parts).alias("total_chunks"), F.posexplode(parts).alias("chunk_index", "text")).select("doc_id", "chunk_index", "total_chunks", "text")


def build_index(rows: DataFrame, dimension: int = 384) -> DataFrame:
    """Index rows with id and vector; the id names document and chunk."""
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string"))
    meta = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("total_chunks"), F.col("total_chunks").cast("string"))
    return rows.select(key.alias("id"), "text", encode(F.col("text"), dimension).alias("vec"), meta.alias("metadata"))


#: Queries of one search; their block is broadcast.
MOST_QUERIES = 1000
#: Rows of the index compared at a time.
BLOCK = 4096


def scores(rows: np.ndarray, asked: np.ndarray, metric: str = "l2sq") -> np.ndarray:
    """1 - distance (rows x queries): squared Euclidean (2 cos - 1 on unit
    vectors) or cosine, 0 for a null vector; to 12 decimals, so that the
    rounding of sums hardly ever parts equal rows."""
    products = rows @ asked.T
    if metric == "l2sq":
        return (1 - ((rows * rows).sum(1)[:, None] - 2 * products + (asked * asked).sum(1)[None, :])).round(12)
    norms = np.sqrt((rows * rows).sum(1)[:, None] * (asked * asked).sum(1)[None, :])
    return np.divide(products, norms, out=np.zeros_like(products), where=norms > 0).round(12)


def search(index: DataFrame, queries: DataFrame, top_k: int = 5, metric: str = "l2sq", where: Column | None = None, key: str = "id") -> DataFrame:
    """(query_id, id, score, rank) of the ``top_k`` rows for each query
    (query_id, qvec).  ``where`` filters the index before ranking.

    At most ``MOST_QUERIES`` queries are broadcast; more are refused, for
    ``search_blocks`` to take.  Blocks of rows are compared with all queries by a
    matrix product, exactly; ties go to the smaller id; only ``top_k`` rows a
    query and partition are shuffled.
    """
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} queries; search them in blocks of {MOST_QUERIES}")
    rows = (index if where is None else index.where(where)).select(F.col(key).alias("id"), "vec").where("vec IS NOT NULL")
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": rows.schema["id"].dataType.simpleString()}
    asked = queries.select("query_id", "qvec").where("qvec IS NOT NULL").toPandas()
    sent = index.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), np.array(asked["qvec"].tolist(), np.float64)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, block = sent.value
        held = Best(len(names), top_k)
        for pdf in batches:
            for at in range(0, len(pdf) if len(names) else 0, BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                held.add(scores(np.array(part["vec"].tolist(), np.float64), block, metric), part["id"].to_numpy())
        yield held.frame(names).drop(columns="at")

    found = rows.mapInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


class Best:
    """The ``top_k`` best rows of each query among the blocks seen so far, none
    below its ``floor``; ties go to the smaller id.  Scores that are no numbers
    do not count."""

    def __init__(self, queries: int, top_k: int, floor: np.ndarray | None = None):
        self.top_k = top_k
        self.floor = np.full(queries, -np.inf) if floor is None else floor.copy()
        self.query, self.id, self.score = np.empty(0, np.int64), np.empty(0, object), np.empty(0)

    def add(self, got: np.ndarray, ids: np.ndarray, who: np.ndarray | None = None) -> None:
        """``got`` (rows x queries) are the scores of the queries ``who``, of all if that is None."""
        k = self.top_k
        who = np.arange(len(self.floor)) if who is None else who
        got = np.where(np.isnan(got), -np.inf, got)
        floor = self.floor[who]
        if len(got) > k:  # all that tie with the last place stay for the ids to decide
            floor = np.maximum(floor, np.partition(got, len(got) - k, axis=0)[len(got) - k])
        row, at = np.nonzero((got >= floor[None, :]) & (got > -np.inf))
        if not len(row):
            return
        query = np.concatenate([self.query, who[at]])
        name = np.concatenate([self.id, ids[row].astype(object)])
        score = np.concatenate([self.score, got[row, at]])
        codes = pd.factorize(name, sort=True)[0]
        order = np.lexsort((np.where(codes < 0, len(name), codes), -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        keep = order[rank < k]
        self.query, self.id, self.score = query[keep], name[keep], score[keep]
        last = order[rank == k - 1]
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])

    def frame(self, names: np.ndarray) -> pd.DataFrame:
        """at, query_id, id, score: ``at`` is the query's place in ``names``."""
        return pd.DataFrame({"at": self.query, "query_id": names[self.query], "id": pd.Series(self.id).infer_objects(), "score": self.score})


def query_blocks(queries: DataFrame, most: int) -> Iterator[DataFrame]:
    """The queries that have a vector in frames of at most ``most``, at least one frame."""
    if queries.count() <= most:
        yield queries
        return
    asked = settle(queries.select("query_id", "qvec").where("qvec IS NOT NULL"))
    left = asked.toLocalIterator()
    given = False
    while (block := list(islice(left, most))) or not given:
        given = True
        yield asked.sparkSession.createDataFrame(block, asked.schema)


def search_blocks(index: DataFrame, queries: DataFrame, top_k: int = 5, metric: str = "l2sq", where: Column | None = None, key: str = "id") -> DataFrame:
    """As ``search``, for any number of queries: each block of ``MOST_QUERIES``
    is one pass over the index, and its result is written before the next."""
    if queries.count() <= MOST_QUERIES:
        return search(index, queries, top_k, metric, where, key)
    found = None
    for block in query_blocks(queries, MOST_QUERIES):
        part = settle(search(index, block, top_k, metric, where, key))
        found = part if found is None else found.unionByName(part)
    # a query_id may be in several blocks
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def retrieve(index: DataFrame, queries: DataFrame, top_k: int = 5, least: float = 0.7, metric: str = "l2sq", where: Column | None = None) -> DataFrame:
    """As ``search_blocks``, then only what scores ``least`` or more."""
    return search_blocks(index, queries, top_k, metric, where).where(F.col("score") >= least)


def context(results: DataFrame, node_rows: DataFrame, edge_rows: DataFrame, concepts: int = 5, near: int = 3) -> DataFrame:
    """(query_id, concept, id, neighbours): concepts named in the top three
    results (query_id, text, rank) that are nodes, with their first neighbours."""
    words = results.where("rank <= 3").select("query_id", F.explode(T.concept_words(F.col("text"))).alias("concept")).distinct()
    first = words.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("concept"))).where(F.col("i") <= concepts).drop("i")
    keyed = first.withColumn("id", T.node_id(F.col("concept"))).join(node_rows.select("id"), "id")
    hop = G.pairs(edge_rows).join(keyed.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    hop = hop.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("adj_seq", "dst"))).where(F.col("i") <= near)
    hop = hop.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "dst"))).alias("r"))
    return keyed.join(hop, keyed["id"] == hop["src"], "left").select("query_id", "concept", "id", F.coalesce(F.transform("r", lambda x: x["dst"]), F.array().cast("array<string>")).alias("neighbours"))


def answer(results: DataFrame) -> DataFrame:
    """(query_id, answer): results (query_id, rank, score, text) put into one text."""
    part = F.concat(F.lit("(Relevance: "), F.format_string("%.2f", "score"), F.lit(") "), F.substring("text", 1, 300), F.lit("..."))
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("answer"))


def index_statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total_documents"), F.max(F.size("vec")).alias("dimension"))
