"""Exact top-k search: exhaustive term-at-a-time accumulation.

Every component of a vector is a term, its quantised value the weight.  A
block of candidate rows is turned into postings (term -> rows, weights); each
query term scatters its weighted postings into a dense score array of the
block; partition selection keeps the k best of the block, and the kept
results of blocks and partitions are merged.

The queries are scanned in passes of a fixed number of rows, one after the
other, so what is in the driver and broadcast has a fixed bound; candidates stream through block by block and
are never shuffled.  Only k rows a query and partition are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut

#: Queries of one pass: the broadcast holds at most this many vectors.
PASS_ROWS = 8192
#: Most numbers in the dense score array of a block.
SCORES = 1 << 22


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): components as floor(256 * x), x as double; rows with a null
    id, a null vector or a null or non-finite component are left out."""
    x = F.col("x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return (
        columns(df, id=id_col, x=vec_col).where(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select(F.col("id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("v"))
    )


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        above = at[scores[at] > cut]
        ties = at[scores[at] == cut]
        need = k - len(above)
        if len(ties) > need:
            ties = ties[np.argpartition(ids[ties], need - 1)[:need]] if need else ties[:0]
        at = np.r_[above, ties]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores (queries x rows of the block), one term after the other."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for term in range(min(queries.shape[1], block.shape[1])):
        weights = block[:, term]
        rows = np.flatnonzero(weights)
        asked = np.flatnonzero(queries[:, term])
        if not len(rows) or not len(asked):
            continue
        if len(rows) == len(block) and len(asked) == len(queries):
            scores += queries[:, term, None] * weights[None, :]
        elif len(rows) == len(block):
            scores[asked] += queries[asked, term, None] * weights[None, :]
        else:
            scores[np.ix_(asked, rows)] += queries[asked, term, None] * weights[None, rows]
    return scores


def _matrix(vectors) -> np.ndarray:
    """Rows of any lengths as one array; what is missing weighs nothing.
    Weights whose scores might leave 64 bits raise an error."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(width, 1)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    largest = isqrt((1 << 62) // max(1, width))
    if (out > largest).any() or (out < -largest).any():
        raise ValueError(f"a weight beyond {largest} has scores beyond 64 bits")
    return out


def top_k(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pass_rows: int = PASS_ROWS) -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` rows with the
    highest integer inner product among all rows with another id.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where
    there are fewer candidates; ties go to the smaller id.  Vectors that are
    null or hold null or non-finite components take no part; vectors of
    unequal length are compared over the shorter one; empty vectors score 0.
    A query id that repeats is asked once, with its smallest vector;
    candidates that repeat are each a row.  Components so large that a score
    might not fit 64 bits (2**30 / 256 at 4 components) raise an error.  An
    empty table gives no rows.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vec_col)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    passes = max(1, -(-n // pass_rows))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("vec_id"), F.lit(passes)))
    found = None
    for p in range(passes):
        got = asked.where(F.col("pass") == p).select("vec_id", "v").orderBy("vec_id").toPandas()
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast((got["vec_id"].to_numpy(np.int64), _matrix(got["v"].tolist())))
        part = rows.mapInPandas(_searcher(sent, k), "query_id long, vec_id long, score long")
        if passes > 1:  # the next pass starts when this one is written and its queries are gone
            part = cut(part, "topk")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searcher(sent, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, qv = sent.value
        step = max(1, SCORES // max(1, len(qid)))
        held: list[list[np.ndarray]] = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in qid]
        for pdf in batches:
            ids, vectors = pdf["vec_id"].to_numpy(np.int64), pdf["v"].tolist()
            for at in range(0, len(ids), step):
                own, block = ids[at : at + step], _matrix(vectors[at : at + step])
                scores = accumulate(qv, block)
                for i, q in enumerate(qid):
                    s, c = scores[i], own
                    if (same := own == q).any():
                        s, c = s[~same], c[~same]
                    if len(held[i][0]) >= k:  # only what can displace a held row
                        good = s >= held[i][0][-1]
                        if not good.any():
                            continue
                        s, c = s[good], c[good]
                    s, c = np.r_[held[i][0], s], np.r_[held[i][1], c]
                    keep = best(s, c, k)
                    held[i] = [s[keep], c[keep]]
        sizes = [len(h[0]) for h in held]
        if sum(sizes):
            yield pd.DataFrame({
                "query_id": np.repeat(qid, sizes),
                "vec_id": np.concatenate([h[1] for h in held]),
                "score": np.concatenate([h[0] for h in held]),
            })

    return search
