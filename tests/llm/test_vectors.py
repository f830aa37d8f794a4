"""Hard negatives and centroids against plain Python on small vectors."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("loomgraph.llm")

from loomgraph.llm import centroids, hard_negatives  # noqa: E402

ROWS = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def single(rows):
    """The components as the table holds them."""
    return [(i, v and [x and float(np.float32(x)) for x in v], label) for i, v, label in rows]


def clashing(df):
    from pyspark.sql import functions as F

    for name in ("x", "v", "cells", "cluster", "at", "total", "anchor_id", "rank", "positive_score", "distance", "VEC_ID2"):
        df = df.withColumn(name, F.lit("other"))
    return df


# 12 ---------------------------------------------------------------------

def brute_negatives(rows, every=50):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in good if i % every == 0}):
        label, q = min((lab, v) for i, lab, v in good if i == a)
        ranked = sorted((-sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in good if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [(i, -t) for t, i, lab in ranked if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, n, i, -s, t) for n, (i, t) in enumerate(fit, 1)]
    return out


def vectors(seed, n, width, labels):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.7, 1.0]) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    rows += [(i + 2 * n, [rng.gauss(0, 1) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors(3, 220, 6, 3)
    rows += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1050, [NAN] * 6, 1), (1100, [INF] + [0.0] * 5, 0), (1150, [], 0), (1200, [0.5, 0.5], 1), (None, [1.0] * 6, 1), (1250, [1.0] * 6, None)]
    rows += [(7, [1.0] * 6, 1)] * 3 + [(1300, [1.0] * 6, 2), (1300, [0.5] * 6, 2), (1300, [0.5] * 6, 1)]
    rows = single(rows)
    df = clashing(spark.createDataFrame(rows, ROWS)).repartition(3)
    expected = brute_negatives(rows)
    assert len(expected) > 100
    for passes in (4096, 5):
        assert sorted(map(tuple, hard_negatives.mine(df, pass_rows=passes).collect())) == sorted(expected)


def test_hard_negatives_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.6], 0)], ROWS)
    assert [tuple(r) for r in hard_negatives.mine(df).collect()] == [(0, 1, 1, 2, 256 * 256, 256 * 153)]
    for few in (df.limit(0), df.where("vec_id = 0"), df.where("vec_id > 0"), df.where("vec_id < 2")):
        assert hard_negatives.mine(few).collect() == []


def test_vectors_too_large_for_scores_are_refused(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, [3e15], 1), (1, [1.0], 1)], ROWS)).collect()


def block(n=4000, width=32, seed=1):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(size=(n, width)) / width**0.5).astype(np.int64)
    edges = hard_negatives.fit_edges(x[: n // 4])
    return x, edges, hard_negatives.Block(np.arange(n), rng.integers(0, 4, n), hard_negatives.cells_of(x, edges), x, edges)


def test_bounds_hold_every_score():
    x, _, b = block()
    for q in (x[0], x[17], -x[3], np.zeros(32, np.int64)):
        low, high = b.bounds(q, slice(0, len(b.ids)))
        scores = b.scores(q, np.arange(len(b.ids)))
        assert (low <= scores).all() and (scores <= high).all()


def test_few_rows_are_scored_exactly():
    x, _, b = block()
    counts = []
    for i in range(40):
        label = int(b.labels[b.ids == i][0])
        held = hard_negatives.Best(5)
        counts.append(hard_negatives.positives_in(b, i, label, x[i], held))
        windows = {w: hard_negatives.Best(3) for p in held.scores.tolist() if (w := hard_negatives.window_of(p))[0] <= w[1]}
        counts[-1] += hard_negatives.negatives_in(b, i, label, x[i], windows)
    assert sum(counts) / len(counts) < 0.05 * len(x)


# 13 ---------------------------------------------------------------------

def brute_clusters(rows, clusters=8, rounds=10, seed=3, width=64):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)][:clusters]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in c]
        return min(range(len(c)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        at = [near(v)[0] for _, v in good]
        for j in range(len(c)):
            own = [v for (_, v), k in zip(good, at) if k == j]
            if own:
                c[j] = [sum(column) // len(own) for column in zip(*own)]
    found = [(i, *near(v)) for i, v in good]
    own, names = Counter(), [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    for _, j, d in found:
        own[j] += d
    return Counter((i, j, d, own[j], sum(own.values()), names[j]) for i, j, d in found)




@pytest.mark.parametrize("width", [3, 64])
def test_clusters_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.5005, 1.0]) + i % 3 for _ in range(width)], 0) for i in range(150)]
    rows += [(200 + i, [round(rng.gauss(0, 0.3), 3) for _ in range(width)], 0) for i in range(150)]
    rows += [(7, [0.5] * width, 0)] * 4 + [(8, [0.25] * width, 1), (None, [0.1] * width, 1)]
    rows += [(500, None, 0), (501, [], 0), (502, [1.0] * (width - 1), 0), (503, [1.0] * (width + 1), 0), (504, [NAN] * width, 0), (505, [INF] + [0.0] * (width - 1), 0), (506, [None] + [0.0] * (width - 1), 0)]
    rows = single(rows)
    df = clashing(spark.createDataFrame(rows, ROWS)).repartition(3)
    got = centroids.cluster(df, width=width)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_clusters(rows, width=width)


def test_clusters_of_few_and_equal_rows(spark):
    for rows in ([], [(1, None, 0)], [(1, [0.5, 1.0], 0)], [(i, [0.5, 1.0], 0) for i in range(20)], [(5, [0.5, 1.0], 0)] * 20):
        got = centroids.cluster(spark.createDataFrame(rows, ROWS), rounds=2, width=2)
        assert Counter(tuple(r)[:6] for r in got.collect()) == brute_clusters(rows, rounds=2, width=2)


def test_intervals_hold_and_ties_go_to_the_smallest_number():
    rng = np.random.default_rng(2)
    for scale in (3, 1024, centroids.LARGEST):
        x = rng.integers(-scale, scale + 1, (500, 64))
        c = np.r_[x[:4], x[:4], rng.integers(-scale, scale + 1, (8, 64))]
        low, high = centroids.intervals(x, c)
        exact = [[sum(b * b - 2 * a * b for a, b in zip(v, w)) for w in c.tolist()] for v in x[:40].tolist()]
        for i, row in enumerate(exact):
            for j, d in enumerate(row):
                assert low[i, j] <= d <= high[i, j]
        found, again = centroids.nearest(x, c)
        assert found.tolist() == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1).tolist()
        assert 4 <= again < 500


def test_components_too_large_for_distances_are_refused(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(spark.createDataFrame([(0, [3e15, 1.0], 1), (1, [1.0, 0.0], 1)], ROWS), width=2).collect()
