"""Search by cells against the search that compares all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cells, retrieve

INDEX = "id string, vec array<float>, label int, cell string"


def points(seed=5, groups=12, each=40, width=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width)) * 3
    return np.repeat(middles, each, 0) + rng.normal(size=(groups * each, width)) * 0.2


@pytest.fixture(scope="module")
def rows(spark):
    x = points().tolist()
    out = [(f"r{i:04d}", v, i % 4, "own") for i, v in enumerate(x)]
    out += [(f"copy{i}", x[17], 1, None) for i in range(30)]  # ties, more than top_k
    out += [("none", None, 1, None), ("hole", [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, None), ("nan", [float("nan")] * 6, 1, None), ("endless", [float("inf")] * 6, 1, None), ("zero", [0.0] * 6, 1, None), ("zero2", [0.0] * 6, 2, None)]
    return spark.createDataFrame(out, INDEX).cache()


@pytest.fixture(scope="module")
def asked(spark):
    x = points()
    out = [(i, x[i * 40 + 3].tolist()) for i in range(10)] + [(17, x[17].tolist()), (50, [0.0] * 6), (51, None), (0, x[100].tolist()), (52, [100.0] + [0.0] * 5)]
    return spark.createDataFrame(out, "query_id long, qvec array<double>").cache()


def same(got, want):
    """Queries, rows and ranks are equal, scores but for the rounding of sums."""
    a, b = (sorted(df.select("query_id", "rank", "id", "score").collect()) for df in (got, want))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b], abs=1e-9)


def whole(rows):
    """Rows that take part: the other search has no rule for the rest."""
    return rows.where("id NOT IN ('none', 'hole', 'nan', 'endless')")


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_cells_give_what_all_rows_give(spark, rows, asked, metric):
    index = cells.build(rows, metric=metric)
    assert index.rows.count() == whole(rows).count()
    same(cells.search(index, asked, 4), retrieve.search(whole(rows), asked, 4, metric))
    some = F.col("label") == 1
    same(cells.search(index, asked, 7, some), retrieve.search(whole(rows), asked, 7, metric, some))
    same(cells.search(index, asked, 5, least=0.9), retrieve.search(whole(rows), asked, 5, metric).where("score >= 0.9"))
    same(cells.search(index, asked, 1000), retrieve.search(whole(rows), asked, 1000, metric))
    assert cells.search(index, asked, 4, F.col("label") == 9).count() == 0
    assert cells.search(index, asked.where("qvec IS NULL"), 4).count() == 0


def test_most_rows_are_skipped(spark, rows, asked):
    index = cells.build(rows)
    seen = cells.scanned(index, asked.where("query_id < 10"), 3).collect()
    assert len(seen) == 11 and {r.of_rows for r in seen} == {whole(rows).count()}
    assert max(r["rows"] for r in seen) < 0.35 * seen[0].of_rows
    loose = cells.scanned(index, asked.where("query_id = 50"), 3).first()
    assert loose["rows"] <= loose.of_rows
    plan = index.rows.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_any_centres_are_exact(spark, rows, asked):
    want = retrieve.search(whole(rows), asked, 4)
    same(cells.search(cells.build(rows, n_cells=1), asked, 4), want)
    same(cells.search(cells.build(rows, n_cells=90, sample=50, rounds=0), asked, 4), want)


def test_blocks_of_queries(spark, rows, asked, monkeypatch):
    index = cells.build(rows, metric="cosine")
    monkeypatch.setattr(cells, "MOST_QUERIES", 4)
    same(cells.search(index, asked, 4), retrieve.search(whole(rows), asked, 4, "cosine"))
    with pytest.raises(ValueError):
        cells.scanned(index, asked)


def test_appended_once_and_loaded(spark, rows, asked):
    old, new = rows.where("label < 2"), rows.where("label >= 1").withColumn("vec", F.col("vec").cast("array<double>"))
    index = cells.build(old)
    for _ in range(2):
        index = cells.append(index, new)
    assert index.rows.count() == whole(rows).count()
    same(cells.search(cells.load(spark, index.folder), asked, 4), retrieve.search(whole(rows), asked, 4))


def test_nothing_to_find(spark, rows, asked):
    empty = cells.build(rows.limit(0))
    assert cells.search(empty, asked).count() == 0
    with pytest.raises(ValueError):
        cells.append(empty, rows)
    zeros = cells.build(rows.where("id LIKE 'zero%'"), metric="cosine")
    same(cells.search(zeros, asked, 1), retrieve.search(rows.where("id LIKE 'zero%'"), asked, 1, "cosine"))
    one = cells.build(rows.where("id = 'r0001'"))
    assert [r.id for r in cells.search(one, asked.where("query_id = 3")).collect()] == ["r0001"]
