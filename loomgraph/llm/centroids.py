"""Exact k-means rounds on integer vectors, screened in float32.

Vectors and centroids are integers, so distances, ties and means are exact and
do not depend on how rows are dealt.  Finding the nearest centroid is the work:
a float32 matrix product gives all squared distances of a block approximately,
and a bound of its rounding error makes each an interval that holds the true
one.  Centroids whose interval starts beyond the smallest interval end cannot
be nearest.  Where more than one is left, those are recomputed with integers
and the smallest number wins a tie.

A round sends the centroids (k rows of fixed width) to all tasks; each task
returns exact sums of its vectors by centroid and component, at most k times
the width, however many rows it has.  No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut, trim

WIDTH, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Rows of a block of the matrix product.
BLOCK = 8192
#: Components up to this size have distances that 64 bits hold with room: 64 * (2 * 2**27)**2 = 2**62.
LARGEST = 1 << 27
#: Unit roundoff of float32.
UNIT32 = 2.0**-24

RESULT = "vec_id long, cluster int, distance long"
FACTS = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
ORDER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]


def kept(ids: pa.Array, vectors: pa.ListArray, width: int = WIDTH) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(SCALE * x) of the vectors with ``width`` components, none null or non-finite."""
    good = np.array(vectors.value_lengths().fill_null(-1)) == width
    rows = vectors.filter(pa.array(good))
    values = rows.flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # null components come as NaN
    fine = np.isfinite(x).all(1)
    good[good] = fine
    x = np.floor(x[fine] * SCALE)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component of {np.abs(x).max():g} has distances beyond 64 bits")
    return ids.filter(pa.array(good)), x.astype(np.int64)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|**2 - 2 x.c for all rows of ``x`` and ``c``,
    which orders centroids as the distance does.

    A float32 inner product of n terms in any order, of factors rounded to
    float32 before, is off by at most gamma * |x| |c|, gamma = m u / (1 - m u)
    with m = n + 2.  The norms are computed in double and taken a little larger;
    the same allowance covers the last sum, which is in double, too.
    """
    m = (x.shape[1] + 2) * UNIT32
    gamma = m / (1 - m)
    x64, c64 = x.astype(np.float64), c.astype(np.float64)
    square = (c64 * c64).sum(1)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    reach = np.sqrt((x64 * x64).sum(1))[:, None] * np.sqrt(square)[None, :]
    error = 2 * gamma * reach * (1 + 1e-9) + 1e-12 * (square[None, :] + 2 * reach)
    middle = square[None, :] - 2 * product
    return middle - error, middle + error


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest row of ``c`` (squared Euclidean distance, the smallest
    number of equal ones) for each row of ``x``; with it how many rows needed
    integers."""
    low, high = intervals(x, c)
    possible = low <= high.min(1, keepdims=True)
    found = possible.argmax(1)
    again = np.flatnonzero(possible.sum(1) > 1)
    if len(again):
        row, number = np.nonzero(possible[again])
        d = ((x[again][row] - c[number]) ** 2).sum(1)
        order = np.lexsort((number, d, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        found[again] = number[first]
    return found, len(again)


def _blocks(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids, x = kept(part.column("vec_id"), part.column("x"), width)
            if len(x):
                yield ids, x
        trim()


def _sums(sent, width: int):
    """Sums and counts of a task's vectors by cluster and component (-1: the count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, counts = np.zeros((len(c), width), np.int64), np.zeros(len(c), np.int64)
        for _, x in _blocks(batches, width):
            at, _ = nearest(x, c)
            counts += np.bincount(at, minlength=len(c))
            for i in np.unique(at):
                sums[i] += x[at == i].sum(0)
        full = np.flatnonzero(counts)
        table = np.c_[counts[full], sums[full]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(full))), pa.array(table.ravel())], names=["cluster", "at", "total"]
        )

    return run


def _assign(sent, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for ids, x in _blocks(batches, width):
            at, _ = nearest(x, c)
            d = ((x - c[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, width: int = WIDTH) -> np.ndarray:
    """The kept vectors with the smallest sha256 of ``seed:id``, in that order."""
    sound = F.coalesce((F.size("x") == width) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull() & sound).select(key.alias("key"), F.transform("x", lambda c: F.floor(c.cast("double") * SCALE)).alias("v")).orderBy("key", "v").limit(clusters)
    return np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, width)


def means(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """The next centroids: floor of the exact mean of the vectors nearest to
    each, componentwise; a centroid without vectors stays."""
    spark, width = rows.sparkSession, c.shape[1]
    sent = spark.sparkContext.broadcast(c)
    found = rows.mapInArrow(_sums(sent, width), "cluster int, at int, total long")
    got = found.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sent.destroy()
    totals = {(r["cluster"], r["at"]): int(r["total"]) for r in got}
    return np.array([[totals[i, j] // totals[i, -1] for j in range(width)] if (i, -1) in totals else c[i].tolist() for i in range(len(c))], np.int64).reshape(-1, width)


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and
    centroid of every vector that is kept: those with exactly ``width``
    components, none null or non-finite, as floor(1024 * x).

    Fewer kept ids than ``clusters`` give as many centroids; centroids may be
    equal, then the smaller number has all vectors and the other stays.  A null
    id is no seed, but its vector is clustered and keeps the null; ids that
    repeat are vectors of their own (as seeds the smaller vector first).  An
    empty table gives none.  Components beyond 2**27, whose distances 64 bits
    cannot hold, raise an error.  ``df`` is read ``rounds`` + 2 times: hand in
    a written table.  Driver and tasks hold clusters * width numbers.
    """
    spark = df.sparkSession
    rows = columns(df, vec_id=id_col, x=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    c = seeds(rows, clusters, seed, width)
    if not len(c):  # without a seed there is nothing to be near to
        return spark.createDataFrame([], f"vec_id long, distance long, {FACTS}").select(*ORDER)
    for _ in range(rounds):
        c = means(rows, c)
    sent = spark.sparkContext.broadcast(c)
    found = cut(rows.mapInArrow(_assign(sent, width), RESULT), "centroids")
    sent.destroy()
    own = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = [(i, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v) for i, v in enumerate(c.tolist()) if i in own]
    # one row a cluster
    side = F.broadcast(spark.createDataFrame(facts, FACTS))
    return found.join(side, "cluster").select(*ORDER)

