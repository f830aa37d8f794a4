"""Exact hard-negative mining with a vector-approximation file.

Each dimension is cut into cells; a vector's approximation is the cell of each
of its components, one byte a dimension.  For an anchor, a table holds the
least and the largest product that each cell of each dimension can give, so
the sums of table entries are a lower and an upper bound of the score.  Only
rows whose bounds leave them a place among the results are scored exactly.

Anchors are taken in passes of a fixed number.  A pass reads the file twice:
for the positives (best rows of the anchor's label), and for the negatives
(best rows of other labels whose score lies in a window below that of a
positive).  The file streams through block by block; only results travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut, trim
from loomgraph.llm.topk_search import best

#: Anchors of one pass: what is broadcast has at most this many vectors.
PASS_ROWS = 4096
#: Cells of a dimension, and rows that their edges are fitted on (about, twice as many at most).  Any edges give exact results.
CELLS, SAMPLE = 256, 20_000
#: Rows of a block.
BLOCK = 8192
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
WINDOW = (50, 95)


def _integers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(256 * x) of those, shorter ones filled with 0."""
    vectors = batch.column("x")
    sound = ~np.array(vectors.is_null().to_numpy(zero_copy_only=False), bool)
    for name in ("vec_id", "label"):
        sound &= ~np.array(batch.column(name).is_null().to_numpy(zero_copy_only=False), bool)
    vectors = vectors.filter(pa.array(sound))
    sizes = np.array(vectors.value_lengths()).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components come as NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.bincount(row, weights=~np.isfinite(values), minlength=len(sizes)) == 0
    keep = fine[row]
    values = np.floor(256 * values[keep])
    if len(values) and np.abs(values).max() > isqrt((1 << 56) // max(1, width)):
        raise ValueError(f"a component of {np.abs(values).max():g} has scores beyond 64 bits")
    place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]
    out = np.zeros((len(sizes), width), np.int64)
    out[row[keep], place] = values.astype(np.int64)
    sound[sound] = fine
    return sound, out[fine]


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)[: len(x) + 1], pa.array(x.ravel()))


def _approximate(sent, width: int):
    """(vec_id, label, cells, v) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = sent.value
        for batch in batches:
            sound, x = _integers(batch, width)
            if not len(x):
                continue
            cells = cells_of(x, edges)
            ids, labels = (batch.column(c).filter(pa.array(sound)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes() for c in cells], pa.binary()), _listed(x)], names=["vec_id", "label", "cells", "v"])
        trim()

    return run


def cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component: how many edges of its dimension it reaches."""
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8)


def fit_edges(x: np.ndarray) -> np.ndarray:
    """Lower edges of the cells 1 to CELLS - 1 of each dimension, so that rows like these are dealt evenly."""
    at = np.arange(1, CELLS) * len(x) // CELLS
    return np.ascontiguousarray(np.sort(x, 0)[at].T) if len(x) else np.zeros((x.shape[1], CELLS - 1), np.int64)


class Block:
    """Rows of one block in the order of their labels, with what their cells can hold."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, x: np.ndarray, edges: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.cells = np.ascontiguousarray(cells[order].T).astype(np.intp)
        # cells 0 and CELLS - 1 have no outer edge of their own: the block's least and largest values bound them
        self.low = np.c_[self.x.min(0), edges]
        self.high = np.c_[edges - 1, self.x.max(0)]

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def bounds(self, q: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some rows with anchor ``q``.
        Both sums of a cell lie side by side, so that one lookup finds them."""
        a, b = q[:, None] * self.low, q[:, None] * self.high
        table = np.ascontiguousarray(np.stack([np.minimum(a, b), np.maximum(a, b)], -1)).view(np.complex128)[..., 0]
        n = len(self.ids[part])
        sums, found = np.zeros((n, 2), np.int64), np.empty(n, np.complex128)
        for d in np.flatnonzero(q):
            np.take(table[d], self.cells[d, part], out=found, mode="clip")
            sums += found.view(np.int64).reshape(n, 2)
        return sums[:, 0], sums[:, 1]

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.x[at] * q).sum(1)


def _least(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, if there are as many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


class Best:
    """The best (score, id) so far of each of some windows."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def bar(self) -> int | None:
        """Score below which nothing enters any more."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        keep = best(scores, ids, self.k)
        self.scores, self.ids = scores[keep], ids[keep]


def _above(upper: np.ndarray, *bars: int | None) -> np.ndarray:
    known = [b for b in bars if b is not None]
    return upper >= max(known) if known else np.ones(len(upper), bool)


def positives_in(block: Block, anchor: int, label: int, q: np.ndarray, held: Best) -> int:
    """Adds the block's rows of ``label`` that belong to the best ones; returns how many were scored."""
    part = block.of(label)
    if part.start == part.stop:
        return 0
    lower, upper = block.bounds(q, part)
    other = block.ids[part] != anchor
    at = np.flatnonzero(other & _above(upper, held.bar(), _least(lower[other], held.k)))
    held.add(block.scores(q, at + part.start), block.ids[part][at])
    return len(at)


def negatives_in(block: Block, anchor: int, label: int, q: np.ndarray, windows: dict[tuple[int, int], Best]) -> int:
    """As ``positives_in``, for rows of other labels and each window (least and largest score)."""
    every = slice(0, len(block.ids))
    lower, upper = block.bounds(q, every)
    inner = block.of(label)
    possible = (upper >= min(w[0] for w in windows)) & (lower <= max(w[1] for w in windows)) & (block.ids != anchor)
    possible[inner] = False
    rows = np.flatnonzero(possible)
    lower, upper = lower[rows], upper[rows]
    wanted = np.zeros(len(rows), bool)
    asked = {}
    for (least, most), held in windows.items():
        sure = lower[(lower >= least) & (upper <= most)]
        asked[least, most] = (upper >= least) & (lower <= most) & _above(upper, held.bar(), _least(sure, held.k))
        wanted |= asked[least, most]
    scores = np.zeros(len(rows), np.int64)
    scores[wanted] = block.scores(q, rows[wanted])
    for (least, most), held in windows.items():
        at = np.flatnonzero(asked[least, most] & (scores >= least) & (scores <= most))
        if len(at):
            held.add(scores[at], block.ids[rows[at]])
    return int(wanted.sum())


def _blocks(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[Block]:
    width = len(edges)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column("v").flatten().to_numpy().reshape(-1, width)
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, width)
            yield Block(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), cells, x, edges)


def _out(rows: list[tuple[int, int | None, Best]], names: list[str]) -> pa.RecordBatch:
    """Rows of (anchor, the positive's score if any, best ones)."""
    sizes = [len(h.ids) for _, _, h in rows]
    first = [pa.array(np.repeat(np.array([a for a, _, _ in rows], np.int64), sizes))]
    if names[1] == "positive_score":
        first.append(pa.array(np.repeat(np.array([p for _, p, _ in rows], np.int64), sizes)))
    none = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([*first, pa.array(np.concatenate([none, *[h.ids for _, _, h in rows]])), pa.array(np.concatenate([none, *[h.scores for _, _, h in rows]]))], names=names)


def _find_positives(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, ids, labels, vectors = sent.value
        held = [Best(k) for _ in ids]
        for block in _blocks(batches, edges):
            for anchor, label, q, h in zip(ids, labels, vectors, held, strict=True):
                positives_in(block, anchor, label, q, h)
        yield _out([(a, None, h) for a, h in zip(ids, held, strict=True)], ["anchor_id", "positive_id", "positive_score"])
        trim()

    return run


def _find_negatives(sent, k: int, window: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, ids, labels, vectors, scores = sent.value
        held = [{p: Best(k) for p in own} for own in scores]
        # least and largest score for each positive's; some windows hold no number
        windows = [{w: h for p, h in own.items() if (w := window_of(p, window))[0] <= w[1]} for own in held]
        for block in _blocks(batches, edges):
            for anchor, label, q, own in zip(ids, labels, vectors, windows, strict=True):
                if own:
                    negatives_in(block, anchor, label, q, own)
        found = [(a, p, own[w]) for a, per, own in zip(ids, held, windows, strict=True) for p in per if (w := window_of(p, window)) in own]
        yield _out(found, ["anchor_id", "positive_score", "negative_id", "negative_score"])
        trim()

    return run


def window_of(positive: int, window: tuple[int, int] = WINDOW) -> tuple[int, int]:
    """Least and largest score of a negative to a positive's score."""
    return -(-window[0] * positive // 100), window[1] * positive // 100


def approximations(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, np.ndarray]:
    """The file: (vec_id, label, cells, v) of all rows that take part; and the edges of the cells."""
    spark = df.sparkSession
    rows = columns(df, vec_id=id_col, label=label_col, x=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = max(1, width or 1)
    sample = rows.where(F.rand(7) < min(1.0, SAMPLE / max(1, n))).limit(2 * SAMPLE)
    table = sample.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([_listed(_integers(b, width)[1])], names=["v"]) for b in batches), "v array<long>").toPandas()
    edges = fit_edges(np.array(table["v"].tolist(), np.int64).reshape(-1, width))
    sent = spark.sparkContext.broadcast(edges)
    return cut(rows.mapInArrow(_approximate(sent, width), "vec_id long, label long, cells binary, v array<long>"), "negatives-file"), edges


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    df: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", pass_rows: int = PASS_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's
    positives are the ``positives`` rows of its label with the highest integer
    inner products; for each, the ``negatives`` best rows of other labels whose
    score is between the two percentages of ``window`` of the positive's.  Ties
    go to the smaller id; fewer rows where there are fewer.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part.  Vectors of unequal length are compared over the shorter
    one, empty ones score 0.  An anchor id that repeats is asked once, with its
    smallest (label, vector), and no row with its id is its positive or
    negative; other rows that repeat are each a row.  Components whose scores
    64 bits cannot hold raise an error.  An empty table gives no rows.
    """
    spark = df.sparkSession
    file, edges = approximations(df, id_col, vec_col, label_col)
    asked = cut(file.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v"), "negatives-anchors")
    n = asked.count()
    passes = max(1, -(-n // pass_rows))
    out = None
    for p in range(passes):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).orderBy("vec_id").toPandas()
        if not len(got):
            continue
        ids, labels, vectors = got["vec_id"].to_numpy(np.int64), got["label"].to_numpy(np.int64), np.array(got["v"].tolist(), np.int64)
        sent = spark.sparkContext.broadcast((edges, ids, labels, vectors))
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        found = file.mapInArrow(_find_positives(sent, positives), "anchor_id long, positive_id long, positive_score long")
        good = cut(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"), "negatives-positives")
        sent.destroy()
        scores: dict[int, list[int]] = {}
        for r in good.select("anchor_id", "positive_score").distinct().orderBy("anchor_id", "positive_score").collect():  # at most pass_rows * positives
            scores.setdefault(r["anchor_id"], []).append(r["positive_score"])
        sent = spark.sparkContext.broadcast((edges, ids, labels, vectors, [scores.get(a, []) for a in ids.tolist()]))
        order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        found = file.mapInArrow(_find_negatives(sent, negatives, window), "anchor_id long, positive_score long, negative_id long, negative_score long")
        bad = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives")
        sent.destroy()
        part = good.join(bad, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out
