"""A vector index of cells with radii, searched exactly.

Every row lies in the cell of its nearest centre and carries its distance to
it.  A row ``t`` from its centre is at least ``|D - t|`` from a query that is
``D`` from that centre (triangle inequality), so cells, and rows within a cell,
that cannot come into a query's results are not compared with it.  Centres only
decide how much is skipped: any of them give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.retrieve import BLOCK, MOST_QUERIES, Best, query_blocks, scores
from loomgraph.plans.iterate import settle, work_dir

#: Cells of an index at most; their centres are broadcast.
MOST_CELLS = 4096
#: Cell of the vectors without a direction, where the metric is the cosine.
NOWHERE = -1


@dataclass(frozen=True)
class Cells:
    """``rows`` has the columns of the index, ``cell`` and ``to_centre``; the
    table is partitioned by cell."""

    folder: str
    rows: DataFrame
    centres: np.ndarray
    metric: str
    key: str


def _placed(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors where distances rank as the metric does, and which of them have such a place."""
    if metric == "l2sq":
        return vectors, np.ones(len(vectors), bool)
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(norms > 0, norms, 1)[:, None], norms > 0


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64) if len(vectors) else np.zeros((0, 1))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (a x b)."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0))


def _fit(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    points = np.unique(points, axis=0)  # in one order, however they came
    centres = points[np.sort(np.random.default_rng(seed).permutation(len(points))[:k])]
    for _ in range(rounds if len(centres) else 0):
        own = _apart(points, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _usable(index: DataFrame) -> DataFrame:
    """Rows whose vector is there and has numbers only."""
    return index.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))


def _assigned(index: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, to_centre double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        placed, there = _placed(_matrix(vectors), metric)
        cell, away = np.full(len(vectors), NOWHERE), np.zeros(len(vectors))
        for at in range(0, len(vectors), BLOCK):
            rows = at + np.flatnonzero(there[at : at + BLOCK])
            if len(rows):
                apart = _apart(placed[rows], sent.value)
                cell[rows], away[rows] = apart.argmin(1), apart.min(1)
        return pd.DataFrame({"cell": cell, "to_centre": away})

    return index.drop("cell", "to_centre").withColumn("own", nearest("vec")).select(*[c for c in index.columns if c not in ("cell", "to_centre")], "own.cell", "own.to_centre")


def _write(rows: DataFrame, folder: str, key: str, shares: dict[int, float]) -> None:
    """Rows by cell; a cell with a large share of them is written by several tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = {c: int(np.ceil(s * parts)) for c, s in shares.items() if s * parts > 1}
    several = F.lit(1)
    if spread:
        several = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in spread.items() for x in pair]), F.col("cell")), F.lit(1))
    salt = F.pmod(F.xxhash64(key, "vec"), several)
    rows.repartition(parts, "cell", salt).sortWithinPartitions("cell", "to_centre").write.mode("append").partitionBy("cell").parquet(f"{folder}/rows")


def build(index: DataFrame, folder: str | None = None, n_cells: int | None = None, metric: str = "l2sq", key: str = "id", sample: int = 20_000, rounds: int = 8, seed: int = 7) -> Cells:
    """Write an index (``key``, vec, any other columns) by cells.

    Centres come from a sample of at most ``sample`` rows, ``n_cells`` of them
    (the root of the number of rows, ``MOST_CELLS`` at most).  Rows without a
    vector, or whose vector holds a null, a NaN or an infinity, are left out;
    all vectors are of one length.  Columns named ``cell`` and ``to_centre`` are
    replaced.
    """
    spark = index.sparkSession
    folder = folder or f"{work_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}"
    usable = _usable(index)
    n = usable.count()
    few = usable if n <= sample else usable.sample(sample / n, seed).limit(sample)
    placed, there = _placed(_matrix(few.select("vec").toPandas()["vec"]), metric)
    k = n_cells or int(np.ceil(np.sqrt(n)))
    centres = _fit(placed[there], min(max(k, 1), MOST_CELLS), rounds, seed)
    own = np.full(len(placed), NOWHERE)
    if there.any():
        own[there] = _apart(placed[there], centres).argmin(1)
    cell, size = np.unique(own, return_counts=True)
    _write(_assigned(usable, centres, metric), folder, key, dict(zip(cell.tolist(), (size / max(len(own), 1)).tolist(), strict=True)))
    about = [(i, c.tolist(), metric, key) for i, c in enumerate(centres)] or [(NOWHERE, [], metric, key)]
    spark.createDataFrame(about, "cell int, centre array<double>, metric string, key string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return _opened(spark, folder, index, centres, metric, key)


def _opened(spark: SparkSession, folder: str, like: DataFrame, centres: np.ndarray, metric: str, key: str) -> Cells:
    plain = like.drop("cell", "to_centre").schema.add("to_centre", "double").add("cell", "integer")
    return Cells(folder, spark.read.schema(plain).parquet(f"{folder}/rows"), centres, metric, key)


def load(spark: SparkSession, folder: str) -> Cells:
    """An index that ``build`` has written and that has rows."""
    about = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # MOST_CELLS rows at most
    centres = np.array([r["centre"] for r in about if r["cell"] != NOWHERE], np.float64)
    return _opened(spark, folder, spark.read.parquet(f"{folder}/rows"), centres, about[0]["metric"], about[0]["key"])


def append(cells: Cells, rows: DataFrame) -> Cells:
    """Add rows whose key the index does not have, so a repeated append adds
    nothing.  Centres stay as they are; an index without any is refused."""
    if not len(cells.centres):
        raise ValueError("the index has no cells yet: build it")
    same = [F.col(c).cast(kind).alias(c) for c, kind in cells.rows.dtypes if c not in ("cell", "to_centre")]
    fresh = _usable(rows).join(cells.rows.select(cells.key), cells.key, "left_anti").select(*same)
    assigned = settle(_assigned(fresh, cells.centres, cells.metric))
    sizes = assigned.groupBy("cell").count().collect()  # one row a cell
    n = max(sum(r["count"] for r in sizes), 1)
    _write(assigned, cells.folder, cells.key, {r["cell"]: r["count"] / n for r in sizes})
    return _opened(rows.sparkSession, cells.folder, fresh, cells.centres, cells.metric, cells.key)


class _Plan:
    """Which cells each of a block of queries has to see."""

    def __init__(self, cells: Cells, names: np.ndarray, asked: np.ndarray, kind: str, where: Column | None):
        self.cells, self.names, self.asked, self.kind = cells, names, asked, kind
        self.rows = cells.rows if where is None else cells.rows.where(where)
        size = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_centre").alias("low"), F.max("to_centre").alias("high")).orderBy("cell").collect()  # one row a cell
        self.cell = np.array([r["cell"] for r in size], np.int64)
        self.n = np.array([r["n"] for r in size], np.int64)
        low, high = (np.array([r[c] for r in size], np.float64) for c in ("low", "high"))
        placed, there = _placed(asked, cells.metric)
        self.away = np.zeros((len(asked), len(self.cell)))
        has = self.cell != NOWHERE
        if has.any():
            self.away[:, has] = _apart(placed, cells.centres[self.cell[has]])
        least = np.maximum(np.maximum(self.away - high, low - self.away), 0)
        # a cosine of 0, whatever the other vector, is a distance of sqrt(2)
        self.level = ~(there[:, None] & has[None, :])
        self.least = np.where(self.level, np.sqrt(2.0), least)
        far = np.linalg.norm(cells.centres[self.cell[has]], axis=1) + high[has] if has.any() else np.zeros(1)
        self.slack = 1e-6 * (1 + np.linalg.norm(placed, axis=1) + far.max(initial=0))  # rounding

    def first(self, top_k: int) -> np.ndarray:
        """(queries x cells) the nearest cells, until they have ``top_k`` rows."""
        order = np.argsort(np.where(self.level, np.sqrt(2.0), self.away), axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < top_k, axis=1)
        return out

    def reach(self, floor: np.ndarray) -> np.ndarray:
        """How far a row with a score of ``floor`` can be."""
        square = 1 - floor if self.cells.metric == "l2sq" else 2 - 2 * floor
        return np.sqrt(np.maximum(square, 0)) + self.slack

    def scan(self, wanted: np.ndarray, top_k: int, floor: np.ndarray) -> DataFrame:
        """(q, query_id, id, score) of the best rows of the ``wanted`` cells, some of each partition."""
        names, asked, metric, level = self.names, self.asked, self.cells.metric, self.level
        seen = wanted.any(0)
        rows = self.rows.where(F.col("cell").isin(self.cell[seen].tolist()))
        rows = rows.select(F.col(self.cells.key).alias("id"), "vec", "cell", "to_centre")
        sent = self.rows.sparkSession.sparkContext.broadcast((names, asked, {int(c): i for i, c in enumerate(self.cell)}, wanted, self.away, level, self.reach(floor), floor))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, asked, place, wanted, away, level, reach, floor = sent.value
            held = Best(len(names), top_k, floor)
            for pdf in batches:
                for cell, part in pdf.groupby("cell", sort=False):
                    at = place[cell]
                    who = np.flatnonzero(wanted[:, at])
                    bare = level[who, at]
                    from_centre = part["to_centre"].to_numpy()
                    for i in range(0, len(part), BLOCK):
                        near = bare[None, :] | (np.abs(away[who, at][None, :] - from_centre[i : i + BLOCK, None]) <= reach[who][None, :])
                        use = i + np.flatnonzero(near.any(1))
                        if len(use):
                            block = part.iloc[use]
                            held.add(scores(_matrix(block["vec"]), asked[who], metric), block["id"].to_numpy(), who)
            yield held.frame(names).rename(columns={"at": "q"})

        kinds = dict(rows.dtypes)
        return rows.mapInPandas(best, f"q int, query_id {self.kind}, id {kinds['id']}, score double")


def _planned(cells: Cells, queries: DataFrame, top_k: int, least: float | None, where: Column | None) -> tuple[_Plan | None, DataFrame | None, np.ndarray, np.ndarray, np.ndarray]:
    """The plan, what the first cells gave, their cells, those left, and the scores to reach."""
    asked = _usable(queries.select("query_id", F.col("qvec").alias("vec"))).toPandas()
    none = np.zeros((0, 0), bool)
    if not len(asked):
        return None, None, none, none, np.empty(0)
    plan = _Plan(cells, asked["query_id"].to_numpy(), _matrix(asked["vec"]), queries.schema["query_id"].dataType.simpleString(), where)
    floor = np.full(len(asked), -np.inf if least is None else least)
    if not len(plan.cell):
        return plan, None, none, none, floor
    first = plan.first(top_k)
    if least is not None:
        first &= plan.least <= plan.reach(floor)[:, None]
    found = settle(plan.scan(first, top_k, floor))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    last = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == top_k).select("q", "score").collect()  # one row a query
    for r in last:
        floor[r["q"]] = max(floor[r["q"]], r["score"])
    return plan, found, first, (plan.least <= plan.reach(floor)[:, None]) & ~first, floor


def _search(cells: Cells, queries: DataFrame, top_k: int, least: float | None, where: Column | None) -> DataFrame:
    plan, found, _, left, floor = _planned(cells, queries, top_k, least, where)
    if found is None:
        kinds = queries.schema["query_id"].dataType.simpleString(), cells.rows.schema[cells.key].dataType.simpleString()
        found = queries.sparkSession.createDataFrame([], f"q int, query_id {kinds[0]}, id {kinds[1]}, score double")
    elif left.any():
        found = found.unionByName(plan.scan(left, top_k, floor))
    return found.drop("q")


def search(cells: Cells, queries: DataFrame, top_k: int = 5, where: Column | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the rows that ``retrieve.search_blocks`` gives
    for the index's metric, and of those, where ``least`` is given, the ones that
    score as much.

    ``where`` filters rows before ranking; the sizes and radii that cells are
    chosen by are those of the rows it leaves.  Each query first sees the nearest
    cells that hold ``top_k`` rows, then all others that can hold a row as good
    as its last one.  Any number of queries, ``MOST_QUERIES`` a pass; queries
    without a vector give no rows.  The number of cells bounds what the driver
    gets: a row for each.
    """
    found = None
    for block in query_blocks(queries, MOST_QUERIES):
        part = _search(cells, block, top_k, least, where)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def scanned(cells: Cells, queries: DataFrame, top_k: int = 5, where: Column | None = None, least: float | None = None) -> DataFrame:
    """(query_id, cells, rows, of_rows): cells that each query sees, their rows,
    and all rows that it could see, for at most ``MOST_QUERIES`` queries."""
    if queries.count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    plan, _, first, left, _ = _planned(cells, queries, top_k, least, where)
    kind = queries.schema["query_id"].dataType.simpleString()
    out = []
    if plan is not None:
        both = first | left
        rows = both @ plan.n if len(plan.n) else np.zeros(len(plan.names), np.int64)
        many = both.sum(1) if len(plan.n) else rows
        out = [(q, int(c), int(r), int(plan.n.sum())) for q, c, r in zip(plan.names.tolist(), many, rows, strict=True)]
    return queries.sparkSession.createDataFrame(out, f"query_id {kind}, cells long, rows long, of_rows long")
