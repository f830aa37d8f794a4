"""Iterative graph operators: components, distances, paths, centrality.

Each round of a loop is written to the shared folder (``plans.iterate``), so
lineage does not grow and no state is lost with an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import brandes, spans
from loomgraph.operators import graph as G
from loomgraph.plans.iterate import drop, settle


def components(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(id, component): weakly connected, named by the smallest id.

    Star contraction: larger neighbours of a node move to its smallest one,
    then smaller ones to the smallest of them, until nothing changes; the
    number of rounds is about a logarithm of the number of nodes.
    """
    ids = node_rows.select("id")
    ends = edge_rows.where("src != dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    work = settle(ends.join(ids.withColumnRenamed("id", "lo"), "lo", "left_semi").join(ids.withColumnRenamed("id", "hi"), "hi", "left_semi").select("lo", "hi"))
    seen = None
    while True:
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        sym = work.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(work.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
        low = settle(sym.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
        down = settle(sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = settle(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(low, "a").where("m != b").select(F.col("m").alias("lo"), F.col("b").alias("hi"))
        work = settle(small.unionByName(low.select(F.col("m").alias("lo"), F.col("a").alias("hi"))).distinct())
    return ids.join(work.select(F.col("hi").alias("id"), F.col("lo").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def bfs(edge_rows: DataFrame, starts: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """(start, id, d, parent): fewest edges from each start to each node it
    reaches, within ``most`` steps where that is given; the parent is the
    first in adjacency order of those at d - 1."""
    hops = G.pairs(edge_rows).select("src", "dst", "adj_seq")
    if not directed:
        hops = hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "adj_seq")).groupBy("src", "dst").agg(F.min("adj_seq").alias("adj_seq"))
    hops = settle(hops.where("src != dst"))
    seen = settle(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("d"), F.lit(None).cast("string").alias("parent")))
    for d in count(1) if most is None else range(1, most + 1):
        front = seen.where(F.col("d") == d - 1)
        reach = front.join(hops, front["id"] == hops["src"]).groupBy("start", "dst").agg(F.min_by("src", F.struct("adj_seq", "src")).alias("parent"))
        new = settle(reach.select("start", F.col("dst").alias("id"), F.lit(d).alias("d"), "parent").join(seen.select("start", "id"), ["start", "id"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new) if d % 5 else settle(seen.unionByName(new))
    return seen


#: Starts that one long holds, a bit each.
WORD = 64


def _hops(edge_rows: DataFrame, directed: bool) -> DataFrame:
    hops = edge_rows.select("src", "dst").where("src != dst")
    if not directed:
        hops = hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return settle(hops.distinct())


def _bit_levels(hops: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(word, id, d, bits): the starts (word, bit, id) that are ``d`` edges from a
    node.  A word's 64 searches go together: what comes over several edges is one
    OR, which is formed before the shuffle, and a node has a row for each distance
    it lies at, not for each start."""
    seen = front = settle(starts.groupBy("word", "id").agg(F.lit(0).alias("d"), F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    for d in count(1) if most is None else range(1, most + 1):
        reach = front.join(hops, front["id"] == hops["src"]).groupBy("word", F.col("dst").alias("id")).agg(F.bit_or("bits").alias("bits"))
        old = seen.groupBy("word", "id").agg(F.bit_or("bits").alias("old"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        front = settle(reach.join(old, ["word", "id"], "left").select("word", "id", F.lit(d).alias("d"), fresh.alias("bits")).where("bits != 0"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front) if d % 5 else settle(seen.unionByName(front))
    return seen


def _per_start(levels: DataFrame) -> DataFrame:
    """(word, bit, id, d) of the levels."""
    return levels.select("word", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> getbit(bits, i) = 1)")).alias("bit"), "id", "d")


def distances(edge_rows: DataFrame, starts: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """(start, id, d): as ``bfs``, without parents.  64 starts are searched
    together as the bits of one number."""
    at = F.monotonically_increasing_id()  # 64 divides the first one of each partition
    dealt = settle(settle(starts.select("id").distinct()).select("id", at.alias("at")).select("id", F.floor(F.col("at") / WORD).alias("word"), (F.col("at") % WORD).cast("int").alias("bit")))
    levels = _bit_levels(_hops(edge_rows, directed), dealt, most)
    return _per_start(levels).join(dealt.withColumnRenamed("id", "start"), ["word", "bit"]).select("start", "id", "d")


def diameter(node_rows: DataFrame, edge_rows: DataFrame, below: int | None = 1000) -> DataFrame:
    """One row (diameter): of the undirected graph, null if it has no nodes, is
    not connected, or has ``below`` nodes or more (then nothing is searched; None
    lifts that).

    Every node carries bounds of its eccentricity, from the distances to 64
    searched nodes a round: ``e - d`` and ``d`` from below, ``e + d`` from above.
    Nodes that cannot exceed the largest lower bound need no search of their own,
    so a few rounds do, and there is no state for pairs of nodes.
    """
    spark = node_rows.sparkSession
    n = node_rows.count()
    if n == 0 or (below is not None and n >= below):
        return spark.createDataFrame([(None,)], "diameter int")
    hops = _hops(edge_rows, False)
    degree = hops.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    bounds = settle(node_rows.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(0).alias("low"), F.lit(n).alias("high")))
    best = 0
    while True:
        left = bounds.where(F.col("high") > best)
        far = left.orderBy(F.desc("high"), F.desc("degree"), "id").limit(WORD * 3 // 4).collect()  # 48 rows
        near = left.orderBy("low", F.desc("degree"), "id").limit(WORD // 4).collect()  # 16 rows
        chosen = sorted({r["id"] for r in far + near})
        if not chosen:
            return spark.createDataFrame([(best,)], "diameter int")
        starts = spark.createDataFrame([(0, i, x) for i, x in enumerate(chosen)], "word long, bit int, id string")
        each = settle(_per_start(_bit_levels(hops, starts)))
        reached = each.groupBy("bit").agg(F.max("d").alias("e"), F.count(F.lit(1)).alias("n"))  # 64 rows
        if reached.where(F.col("n") != n).count():
            return spark.createDataFrame([(None,)], "diameter int")
        now = each.join(F.broadcast(reached), "bit").groupBy("id").agg(F.max(F.greatest(F.col("e") - F.col("d"), "d")).alias("l"), F.min(F.col("e") + F.col("d")).alias("h"))
        bounds = settle(bounds.join(now, "id").select("id", "degree", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high")))
        best = bounds.agg(F.max("low")).first()[0]


def largest_diameter(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row (diameter): of the undirected graph's largest component, of equal
    ones that of the largest name.  Edges join nodes of ``node_rows``.

    Nodes with one neighbour are counts of it; the graph of the others is
    solved as numbers (``spans``) after its size is checked.  A larger graph, and
    one whose largest components are equal, takes the DataFrame way.
    """
    spark = node_rows.sparkSession
    hops = settle(edge_rows.where("src != dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct())
    degree = hops.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    numbered = _numbered(degree.where("degree > 1"))
    core = hops.join(numbered.select(F.col("id").alias("hi"), F.col("at").alias("tail")), "hi").join(numbered.select(F.col("id").alias("lo"), F.col("at").alias("head")), "lo")
    core = settle(core.select("head", "tail"))
    drop(hops)
    n = numbered.count()
    if 0 < n <= BROADCAST_NODES and core.count() <= BROADCAST_EDGES:
        edges = core.toArrow()
        heads, tails = (edges[x].to_numpy() for x in ("head", "tail"))
        leaves = numbered.select("at", "degree").toArrow().sort_by("at")["degree"].to_numpy() - np.bincount(heads, minlength=n) - np.bincount(tails, minlength=n)
        parts = spans.components(heads, tails, n)
        sizes = np.bincount(parts, 1 + leaves)
        if np.count_nonzero(sizes == sizes.max()) == 1:
            inside = parts == np.argmax(sizes)
            at, on = np.cumsum(inside) - 1, inside[heads]
            return spark.createDataFrame([(spans.diameter(at[heads[on]], at[tails[on]], leaves[inside]),)], "diameter int")
    node_rows, edge_rows = settle(node_rows), settle(edge_rows)
    parts = settle(components(node_rows, edge_rows))
    first = component_sizes(parts).orderBy(F.desc("size"), F.desc("component")).limit(1)
    ids = settle(parts.join(first, "component").select("id"))
    return diameter(ids, G.induced(edge_rows, ids), below=None)


def simple_paths(edge_rows: DataFrame, src: str, dst: str, most: int = 3) -> DataFrame:
    """(path, n): node lists from ``src`` to ``dst`` without a repeated node,
    of at most ``most`` edges; parallel edges give a path several times."""
    hops = edge_rows.select(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst"))
    open_ = hops.where(F.col("hop_src") == src).select(F.array("hop_src", "hop_dst").alias("path"), F.col("hop_dst").alias("at")).where(F.col("at") != src)
    out = None
    for i in range(most):
        done = open_.where(F.col("at") == dst).select("path")
        out = done if out is None else out.unionByName(done)
        if i + 1 < most:
            more = open_.where(F.col("at") != dst).join(hops, F.col("at") == F.col("hop_src"))
            open_ = more.where(~F.array_contains("path", F.col("hop_dst"))).select(F.concat("path", F.array("hop_dst")).alias("path"), F.col("hop_dst").alias("at"))
    return out.withColumn("n_edges", F.size("path") - 1)


def trails(edge_rows: DataFrame, src: str, dst: str, most: int = 3, limit: int = 10) -> DataFrame:
    """(path, n_edges): node lists from ``src`` to ``dst`` over at most ``most``
    edges, none of them used twice (nodes may come again); the first ``limit``,
    shorter ones first, then by the order of their edges."""
    hops = edge_rows.select(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst"), F.struct("edge_seq", "src", "dst", "relation").alias("hop"))
    open_ = hops.where(F.col("hop_src") == src).select(F.array("hop_src", "hop_dst").alias("path"), F.array("hop").alias("used"), F.col("hop_dst").alias("at"))
    out = None
    for i in range(most):
        done = open_.where(F.col("at") == dst).select("path", "used")
        out = done if out is None else out.unionByName(done)
        if i + 1 < most:
            more = open_.join(hops, F.col("at") == F.col("hop_src")).where(~F.array_contains("used", F.col("hop")))
            open_ = more.select(F.concat("path", F.array("hop_dst")).alias("path"), F.concat("used", F.array("hop")).alias("used"), F.col("hop_dst").alias("at"))
    return out.orderBy(F.size("used"), "used").limit(limit).select("path", F.size("used").alias("n_edges"))


def ego(node_rows: DataFrame, edge_rows: DataFrame, centres: DataFrame, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``radius`` steps along edges from the centres, and the edges among them."""
    hops = edge_rows.select("src", F.col("dst").alias("id"))
    front = inside = centres.select("id").join(node_rows.select("id"), "id", "left_semi").distinct()
    for _ in range(radius):
        front = hops.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select("id").distinct()
        inside = inside.unionByName(front).distinct()
    return node_rows.join(inside, "id", "left_semi"), G.induced(edge_rows, inside)


def pagerank(node_rows: DataFrame, edge_rows: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank) after the round that changes ranks by less than ``tolerance``
    a node in all, or after ``rounds`` rounds; parallel edges add weight, nodes
    without edges out spread theirs evenly.  Ranks sum to 1."""
    out = edge_rows.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    hops = settle(edge_rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    base = settle(node_rows.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left").select("id", F.col("has_out").isNull().alias("dangling")))
    n = base.count()
    if not n:
        return node_rows.select("id", F.lit(0.0).alias("rank")).limit(0)
    state = settle(base.withColumn("rank", F.lit(1.0 / n)).withColumn("moved", F.lit(float("inf"))))
    for _ in range(rounds):
        if tolerance and state.agg(F.sum("moved")).first()[0] < n * tolerance:
            break
        lost = state.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        gain = hops.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        fixed = (1 - damping) / n + damping / n * F.col("lost")
        now = state.select("id", "dangling", F.col("rank").alias("was")).join(gain, "id", "left").crossJoin(F.broadcast(lost))
        now = now.select("id", "dangling", "was", (fixed + damping * F.coalesce("gain", F.lit(0.0))).alias("rank"))
        state = settle(now.select("id", "dangling", "rank", F.abs(F.col("rank") - F.col("was")).alias("moved")))
    return state.select("id", "rank")


#: Nodes and edges of the compressed graph up to which it is broadcast and every source is searched in numpy.
BROADCAST_NODES, BROADCAST_EDGES = 4_000_000, 8_000_000


def _ends(ids: DataFrame, hops: DataFrame) -> DataFrame:
    """(id, outs, ins, known): edges of each node, and whether it is one of ``ids``."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = hops.select(F.explode(F.array(F.struct(F.col("src").alias("id"), one.alias("outs"), zero.alias("ins")), F.struct(F.col("dst").alias("id"), zero.alias("outs"), one.alias("ins")))).alias("e")).select("e.*", F.lit(False).alias("known"))
    listed = ids.select("id", zero.alias("outs"), zero.alias("ins"), F.lit(True).alias("known"))
    return ends.unionByName(listed).groupBy("id").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"), F.max("known").alias("known"))


def betweenness(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(id, betweenness): directed, unweighted, parallel edges once, over
    (n - 1)(n - 2).

    Nodes with a single edge, which comes in, lie between none and are counts of
    their neighbours.  The graph of the others is broadcast as numbers, without
    names, after its size is checked, and blocks of searches (``brandes``) are
    dealt to tasks; one row a node and task is summed.  A larger graph takes
    the level-by-level DataFrame way.
    """
    hops = settle(G.pairs(edge_rows).where("src != dst").select("src", "dst"))
    ends = settle(_ends(node_rows, hops))
    n = node_rows.count()
    if not ends.where("NOT known").isEmpty():
        hops = settle(G.induced(hops, node_rows.select("id")))
        ends = settle(_ends(node_rows, hops))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    numbered = _numbered(ends.where("outs > 0 OR ins > 1").select("id", "outs", "ins"))
    drop(ends)
    core = hops.join(numbered.select(F.col("id").alias("dst"), F.col("at").alias("tail")), "dst").join(numbered.select(F.col("id").alias("src"), F.col("at").alias("head")), "src")
    core = settle(core.select("head", "tail"))
    if numbered.count() > BROADCAST_NODES or core.count() > BROADCAST_EDGES:
        total = _brandes_frames(node_rows, hops)
    else:
        spark = node_rows.sparkSession
        drop(hops)
        sizes, edges = numbered.select("at", "outs", "ins").toArrow().sort_by("at"), core.toArrow()
        searches = brandes.Searches(*(edges[x].to_numpy() for x in ("head", "tail")), *(sizes[x].to_numpy() for x in ("outs", "ins")))
        blocks = searches.blocks()
        sent = spark.sparkContext.broadcast((searches, blocks))

        def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            work, roots = sent.value
            sums = np.zeros(work.n)
            for pdf in batches:
                for i in pdf["id"]:
                    work.add(roots[i], sums)
            hit = np.flatnonzero(sums)
            for at in range(0, len(hit), 100_000):
                some = hit[at : at + 100_000]
                yield pd.DataFrame({"at": work.ids[some], "part": sums[some]})

        parts = max(1, min(len(blocks), 4 * spark.sparkContext.defaultParallelism))
        summed = spark.range(0, len(blocks), 1, parts).mapInPandas(accumulate, "at long, part double").groupBy("at").agg(F.sum("part").alias("b"))
        total = numbered.join(summed, "at").select("id", "b")
    return node_rows.select("id").join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``: numbers from 0 without gaps, partition by partition."""
    rows = settle(rows.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    sizes = sorted(rows.groupBy("p").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n")).collect())
    before, shift = 0, []
    for p, m, n in sizes:
        shift.append((p, before - m))
        before += n
    shifts = F.broadcast(rows.sparkSession.createDataFrame(shift, "p int, shift long"))
    return settle(rows.join(shifts, "p").select(*[x for x in rows.columns if x not in ("p", "m")], (F.col("m") + F.col("shift")).alias("at")))


def _brandes_frames(node_rows: DataFrame, hops: DataFrame) -> DataFrame:
    """(id, b) with joins only: path counts forward, dependencies backward."""
    state = settle(node_rows.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    levels = [state]
    while True:
        d = len(levels)
        new = levels[-1].join(hops, levels[-1]["id"] == hops["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        new = settle(new.join(state.select("s", "id"), ["s", "id"], "left_anti").withColumn("d", F.lit(d)).select("s", "id", "d", "sigma"))
        if new.isEmpty():
            break
        levels.append(new)
        state = settle(state.unionByName(new))
    total = None
    delta = None
    for d in range(len(levels) - 1, 0, -1):
        low = levels[d].withColumn("delta", F.lit(0.0)) if delta is None else levels[d].join(delta, ["s", "id"], "left").select("s", "id", "d", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        part = low.select("id", F.col("delta").alias("b"))
        total = part if total is None else total.unionByName(part)
        up = low.select("s", F.col("id").alias("dst"), F.col("sigma").alias("sw"), "delta").join(hops, "dst")
        back = up.join(levels[d - 1].select("s", F.col("id").alias("src"), "sigma"), ["s", "src"])
        delta = settle(back.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("delta")))
    if total is None:
        return node_rows.select("id", F.lit(0.0).alias("b"))
    return total.groupBy("id").agg(F.sum("b").alias("b"))


def graph_statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: nodes, edges, density (parallel edges count), mean and largest
    degree, connectedness, components, largest component, covered nodes."""
    deg = G.degrees(node_rows, edge_rows).agg(F.count(F.lit(1)).alias("num_nodes"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") > 0).alias("covered"))
    m = edge_rows.agg(F.count(F.lit(1)).alias("num_edges"), F.count_distinct("relation").alias("num_relations"))
    comp = component_sizes(components(node_rows, edge_rows)).agg(F.count(F.lit(1)).alias("num_components"), F.max("size").alias("largest_component"))
    n = F.col("num_nodes")
    one = deg.crossJoin(m).crossJoin(comp)  # one row each
    return one.withColumn("density", F.when(n > 1, F.col("num_edges") / (n * (n - 1))).otherwise(0.0)).withColumn("is_connected", F.col("num_components") == 1)


def combined_statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: counts of the schema and of the graph."""
    return G.schema_statistics(node_rows, edge_rows).crossJoin(graph_statistics(node_rows, edge_rows))  # one row each
