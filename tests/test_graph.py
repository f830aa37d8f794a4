"""Extraction, graph building, traversal, reasoning, recommendation."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluate, extract, link, reason, recommend, retrieve, traverse
from loomgraph.operators import graph as G

TEXT = "Machine learning is a branch of artificial intelligence. Python is a popular language. Neural networks are used for deep learning."
TRIPLE = "doc_id long, chunk_index int, triple_seq long, subject string, relation string, object string, confidence double, method string"


def triples(spark, rows):
    return spark.createDataFrame([(1, 0, i, s, r, o, float(c), "pattern") for i, (s, r, o, c) in enumerate(rows)], TRIPLE)


def graph(spark, rows):
    t = triples(spark, [(*r, 1.0) if len(r) == 3 else r for r in rows])
    return G.nodes(t).cache(), G.edges(t).cache()


def found(spark, text, **kw):
    rows = extract.triples(extract.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")), **kw)
    return [(r.subject, r.relation, r.object) for r in rows.orderBy("triple_seq").collect()]


def test_known_text(spark):
    assert found(spark, TEXT) == [("Learning", "IS_A", "Branch"), ("Python", "IS_A", "Popular"), ("Networks", "IS_A", "Used"), ("Are", "USED_FOR", "Deep")]


def test_gaps_of_the_known_text(spark):
    t = extract.triples(extract.chunks(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")))
    n, e = G.nodes(t), G.edges(t)
    kinds = [r.type for r in reason.gaps(n, e).orderBy("rank").collect()]
    assert kinds == ["weakly_connected"] * 8 + ["disconnected_components"] * 6
    stats = traverse.graph_statistics(n, e).first()
    assert (stats.num_nodes, stats.num_edges, stats.num_components) == (8, 4, 4) and stats.density == pytest.approx(4 / 56)
    assert reason.contradictions(n, e).count() == 0 and reason.inferred(n, e).count() == 0 and reason.threads(n, e).count() == 0


def test_every_pattern_and_limits(spark):
    said = {
        "Cars are types of machines": "IS_A", "Water contains salt": "HAS_PART", "Dogs have tails": "HAS_PROPERTY", "Kernel: core of system": "DEFINED_AS", "Heat causes fire": "CAUSES",
        "Work leads to success": "LEADS_TO", "Rain results in floods": "RESULTS_IN", "Glue used for wood": "USED_FOR", "Rule applies to all": "APPLIES_TO", "Cats similar to lions": "SIMILAR_TO",
        "Gold differs from iron": "DIFFERS_FROM", "Spring comes before summer": "BEFORE", "Night after evening": "AFTER",
    }
    for text, rel in said.items():
        assert rel in [r for _, r, _ in found(spark, text)], text
    many = ". ".join(f"Item{i} causes effect{i}" for i in range(15))
    assert len(found(spark, many)) == 10
    assert found(spark, "Fire causes fire. Élan causes héros. élan causes Héros") == [("Élan", "CAUSES", "Héros")]
    assert found(spark, "") == []


def test_weak_methods_are_filtered(spark):
    more = lambda c: F.array(F.struct(F.lit(0).alias("ord"), F.lit("A1").alias("subject"), F.lit("RELATED_TO").alias("relation"), F.lit("B1").alias("object"), F.lit(0.4).alias("confidence"), F.lit("cooccurrence").alias("method")),
                             F.struct(F.lit(1).alias("ord"), F.lit("C1").alias("subject"), F.lit("SEES").alias("relation"), F.lit("C1").alias("object"), F.lit(0.9).alias("confidence"), F.lit("dependency").alias("method")))
    assert found(spark, "Heat causes fire", more=more) == [("C1", "SEES", "C1"), ("Heat", "CAUSES", "Fire")]
    assert found(spark, "Heat causes fire", more=extract.dependency_matches) == [("Heat", "CAUSES", "Fire")]


def test_ids_of_64_bits_keep_their_order(spark):
    docs = spark.createDataFrame([(2**62, "Rain causes floods"), (-(2**63), "Heat causes fire"), (2**63 - 1, "Ice causes falls")], "doc_id long, text string")
    rows = extract.triples(extract.chunks(docs))
    assert [r.subject for r in rows.orderBy("triple_seq").collect()] == ["Heat", "Rain", "Ice"]
    assert [r.id for r in G.nodes(rows).orderBy("node_seq").collect()] == ["heat", "fire", "rain", "floods", "ice", "falls"]
    assert [r.src for r in G.edges(rows).orderBy("edge_seq").collect()] == ["heat", "rain", "ice"]


class Token:
    """A parsed word as far as phrases need it."""

    def __init__(self, text, pos="NOUN", dep="", below=(), lemma=None):
        self.text, self.pos_, self.dep_, self.children, self.lemma_ = text, pos, dep, below, lemma or text
        self.is_punct = not text.isalnum()

    @property
    def subtree(self):
        return [x for c in self.children for x in c.subtree] + [self]


class Parser:
    """'<subject> <verb> <object>' texts, a leading article below its noun."""

    def pipe(self, texts):
        for text in texts:
            a, verb, b = text.split(" | ")
            subject, end = [Token(w[-1], dep=d, below=[Token(x) for x in w[:-1]]) for w, d in ((a.split(), "nsubj"), (b.split(), "dobj"))]
            yield [subject, Token(verb, "VERB", below=[subject, end], lemma=verb.rstrip("s")), end]


def test_dependency_matches_with_a_parser(spark):
    rows = spark.createDataFrame([(1, 0, "the old pump | moves | water !"), (2, 0, "a | x | b")], "doc_id long, chunk_index int, chunk string")
    got = extract.triples(rows, more=lambda c: extract.dependency_matches(c, load=Parser)).collect()
    assert [(r.doc_id, r.subject, r.relation, r.object, r.confidence, r.method) for r in got] == [(1, "Old Pump", "MOVE", "Water", 0.6, "dependency")]


def test_upserts(spark):
    n, e = graph(spark, [("ML", "IS_A", "Field", 0.7), ("ml", "IS_A", "Field", 0.9), ("Weak", "IS_A", "Field", 0.59), ("Edge", "IS_A", "Field", 0.6), ("", "IS_A", "x", 1.0)])
    got = {r.id: (r.label, r.mentions) for r in n.collect()}
    assert got["ml"] == ("ML", 2) and "weak" in got and len(got) == 4
    edges = {(r.src, r.dst): (r.confidence, r.n_provenance) for r in e.collect()}
    assert edges == {("ml", "field"): (0.9, 2), ("edge", "field"): (0.6, 1)}


def test_nodes_stated_with_properties(spark):
    rows = [(1, "Big Pump", None, {"a": "1", "b": "2"}, "x"), (2, "big pump", "TOOL", {"a": "3"}, None), (3, "Big Pump", "PART", None, "y"), (4, "", None, {"a": "0"}, "z"), (5, None, None, None, None), (6, "Valve", None, None, None)]
    got = G.described_nodes(spark.createDataFrame(rows, "seq long, label string, type string, properties map<string,string>, source string"))
    assert [(r.id, r.label, r.node_seq, r.type, r.properties, r.provenance) for r in got.orderBy("node_seq").collect()] == [
        ("big_pump", "Big Pump", 1, "CONCEPT", {"a": "3", "b": "2"}, ["x", "y"]), ("valve", "Valve", 6, "CONCEPT", {}, [])]
    edges = graph(spark, [("a1", "IS_A", "b1")])[1]
    assert G.schema_statistics(got, edges).first().nodes_with_provenance == 1


def test_inference(spark):
    n, e = graph(spark, [("A1", "IS_A", "B1"), ("B1", "IS_A", "C1"), ("B1", "USED_FOR", "D1")])
    assert {(r.source, r.target, r.relation) for r in reason.inferred(n, e).collect()} == {("a1", "c1", "IS_A"), ("a1", "d1", "RELATED_TO")}
    n, e = graph(spark, [("A1", "IS_A", "B1"), ("B1", "IS_A", "C1"), ("A1", "X", "C1"), ("B1", "IS_A", "A1")])
    assert reason.inferred(n, e).count() == 0


def test_contradictions(spark):
    n, e = graph(spark, [("X1", "CAUSES", "Y1"), ("X1", "PREVENTS", "Y1"), ("Y1", "IS_NOT", "X1")])
    assert [(r.source, r.relation_1, r.relation_2, r.confidence) for r in reason.contradictions(n, e).collect()] == [("x1", "CAUSES", "PREVENTS", 0.9)]


def test_sibling_gaps(spark):
    n, e = graph(spark, [("Hub", "R1", "A1"), ("Hub", "R1", "B1"), ("Hub", "R1", "C1"), ("A1", "R1", "B1")])
    assert {tuple(r.related) for r in reason.sibling_gaps(n, e).collect()} == {("hub", "a1", "c1"), ("hub", "b1", "c1")}


def test_graph_quality_with_a_loop(spark):
    t = triples(spark, [("A1", "R1", "B1", 1.0), ("B1", "R1", "C1", 1.0), ("C1", "R1", "A1", 1.0), ("A1", "R2", "A1", 1.0), ("Alone", "R1", "A1", 0.1)])
    q = evaluate.graph_quality(G.nodes(t), G.edges(t)).first()
    assert (q.coverage, q.connectivity, q.avg_node_degree) == (0.75, 0.75, 2.0)
    assert "Low" not in evaluate.report(evaluate.graph_quality(G.nodes(t), G.edges(t))).first()["value"]


def random_graph(seed, n=14, m=26):
    rng = random.Random(seed)
    return [(f"N{rng.randrange(n)}", "R1", f"N{rng.randrange(n)}") for _ in range(m)]


def adjacency(rows):
    adj = defaultdict(dict)
    for s, _, o in rows:
        adj[s.lower()].setdefault(o.lower(), None)
        adj[o.lower()]
    return {k: [x for x in v if x != k] for k, v in adj.items()}


def distances(adj, s):
    d, level = {s: 0}, [s]
    while level:
        nxt = []
        for x in level:
            for y in adj[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    nxt.append(y)
        level = nxt
    return d


@pytest.mark.parametrize("seed", [1, 2])
def test_traversal_equals_plain_python(spark, seed):
    rows = random_graph(seed)
    n, e = graph(spark, rows)
    adj = adjacency(rows)
    got = {(r.start, r.id): r.d for r in traverse.bfs(e, n).collect()}
    assert got == {(s, t): d for s in adj for t, d in distances(adj, s).items()}
    assert {(r.start, r.id): r.d for r in traverse.distances(e, n).collect()} == got
    near = {k: v for k, v in got.items() if v <= 1}
    assert {(r.start, r.id): r.d for r in traverse.distances(e, n, 1).collect()} == near
    both = defaultdict(list)
    for s, ts in adj.items():
        for t in ts:
            both[s].append(t)
            both[t].append(s)
    both = {s: both[s] for s in adj}
    comp = {r.id: r.component for r in traverse.components(n, e).collect()}
    assert comp == {s: min(distances(both, s)) for s in adj}
    every = [distances(both, s) for s in adj]
    want = max(max(x.values()) for x in every) if all(len(x) == len(adj) for x in every) else None
    assert traverse.diameter(n, e).first()["diameter"] == want


def test_diameter_of_larger_graphs(spark):
    ids = spark.range(150).selectExpr("concat('n', id) AS id")
    pick = random.Random(9)
    ring = [(i, (i + 1) % 12) for i in range(12)] + [(i, i + 1) for i in range(12, 15)] + [(7, 12), (7, 7)]  # a ring, and a tail of four at its seventh node
    chords = [(pick.randrange(12), pick.randrange(12)) for _ in range(3)]
    leaves = [(pick.randrange(14), i) for i in range(16, 150)]
    for rows in (ring + leaves, ring + leaves + chords, [(0, i) for i in range(1, 150)], ring):
        e = spark.createDataFrame([(f"n{a}", f"n{b}", i) for i, (a, b) in enumerate(rows)], "src string, dst string, edge_seq long")
        both = {f"n{i}": set() for i in range(150)}
        for a, b in rows:
            both[f"n{a}"].add(f"n{b}")
            both[f"n{b}"].add(f"n{a}")
        every = [distances(both, x) for x in both]
        want = max(max(x.values()) for x in every) if all(len(x) == 150 for x in every) else None
        assert traverse.diameter(ids, e).first()["diameter"] == want
    assert traverse.diameter(ids, e, below=150).first()["diameter"] is None
    assert traverse.diameter(ids.limit(1), e.limit(0)).first()["diameter"] == 0
    assert traverse.diameter(ids.limit(0), e.limit(0), None).first()["diameter"] is None
    every = traverse.distances(e, ids, directed=False)
    assert every.count() == sum(len(distances(both, x)) for x in both)


def test_diameter_of_the_largest_component(spark, monkeypatch):
    pick = random.Random(4)
    tree = [(f"n{pick.randrange(max(0, i - 4), i)}", "r", f"n{i}") for i in range(1, 60)]
    chords = [(f"n{pick.randrange(30)}", "r", f"n{pick.randrange(30)}") for _ in range(8)]
    other = [(f"z{i}", "r", f"z{i + 1}") for i in range(40)]
    with monkeypatch.context() as patch:
        patch.setattr(traverse, "_bit_levels", None)  # rounds of joins over all nodes
        patch.setattr(traverse, "components", None)
        for rows in (tree, tree + chords + other):
            both = defaultdict(set)
            for a, _, b in rows:
                both[a].add(b)
                both[b].add(a)
            most = max((distances(both, x) for x in both), key=len)
            want = max(max(distances(both, x).values()) for x in most)
            assert traverse.largest_diameter(*graph(spark, rows)).first()["diameter"] == want
    equal = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("x", "r", "y"), ("y", "r", "z")]
    assert traverse.largest_diameter(*graph(spark, equal)).first()["diameter"] == 2  # of the larger name
    monkeypatch.setattr(traverse, "BROADCAST_NODES", 1)
    assert traverse.largest_diameter(*graph(spark, equal[:3])).first()["diameter"] == 1


def brandes(adj):
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        d = distances(adj, s)
        order = sorted(d, key=d.get)
        sigma = dict.fromkeys(adj, 0)
        sigma[s] = 1
        for x in order:
            for y in adj[x]:
                if d[y] == d[x] + 1:
                    sigma[y] += sigma[x]
        delta = dict.fromkeys(adj, 0.0)
        for x in reversed(order):
            for y in adj[x]:
                if d[y] == d[x] + 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if x != s:
                score[x] += delta[x]
    n = len(adj)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_both_ways(spark, monkeypatch):
    rows = random_graph(3)
    n, e = graph(spark, rows)
    want = brandes(adjacency(rows))
    for limit in (200_000, 0):
        monkeypatch.setattr(traverse, "BROADCAST_NODES", limit)
        got = {r.id: r.betweenness for r in traverse.betweenness(n, e).collect()}
        assert got == pytest.approx(want)


def test_betweenness_of_many_nodes_keeps_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(traverse, "_brandes_frames", None)  # would hold each pair of source and reached node
    nodes = spark.range(250_000).selectExpr("concat('n', id) AS id")
    edges = spark.createDataFrame([("n1", "n9", "r", 0), ("n9", "n200000", "r", 1), ("n200000", "n5", "r", 2), ("n9", "n7", "r", 3)], "src string, dst string, relation string, edge_seq long")
    got = {r.id: r.betweenness for r in traverse.betweenness(nodes, edges).where("betweenness > 0").collect()}
    scale = 1 / (249_999 * 249_998)
    assert got == pytest.approx({"n9": 3 * scale, "n200000": 2 * scale})
    assert traverse.betweenness(nodes, edges).count() == 250_000


def test_betweenness_leaves_count_without_state(spark, monkeypatch):
    monkeypatch.setattr(traverse, "_brandes_frames", None)  # would hold each pair of source and reached node
    monkeypatch.setattr(traverse, "BROADCAST_NODES", 60)
    pick = random.Random(5)
    rows = [(pick.choice("abcdefgh"), pick.choice("abcdefgh")) for _ in range(16)] + [(pick.choice("abcdefgh"), f"leaf{i}") for i in range(200)]
    rows += [(x, f"end{i}") for i in range(12) for x in pick.sample("abcdefgh", 1 + i % 4)] + [(f"p{i}", x) for i in range(24) for x in pick.sample("abcdefgh", 1 + i % 3)]
    rows += [(f"p{i}", f"end{i % 12}") for i in range(24)] + [("p1", "leaf201"), ("p1", "p1")]
    n, e = graph(spark, [(a, "r", b) for a, b in rows])
    got = {r.id: r.betweenness for r in traverse.betweenness(n, e).collect()}
    assert got == pytest.approx(brandes(adjacency([(a, "r", b) for a, b in rows])))


def test_pagerank_sums_to_one(spark):
    n, e = graph(spark, random_graph(4))
    ranks = [r["rank"] for r in traverse.pagerank(n, e).collect()]
    assert sum(ranks) == pytest.approx(1)
    star = graph(spark, [(f"L{i}", "R1", "Hub") for i in range(5)])
    top = traverse.pagerank(*star).orderBy(F.desc("rank")).first()
    assert top.id == "hub"


def test_pagerank_stops_at_the_tolerance(spark):
    n, e = graph(spark, random_graph(7))
    ids = sorted(r.id for r in n.collect())
    at = {x: i for i, x in enumerate(ids)}
    hops = np.zeros((len(ids), len(ids)))
    for r in e.collect():
        hops[at[r.src], at[r.dst]] += 1
    out = hops.sum(1, keepdims=True)
    hops = np.where(out > 0, hops / np.maximum(out, 1), 1 / len(ids))
    for tolerance in (1e-2, 1e-6):
        rank, moved, rounds = np.full(len(ids), 1 / len(ids)), np.inf, 0
        while moved >= tolerance * len(ids):
            now = 0.15 / len(ids) + 0.85 * rank @ hops
            rank, moved, rounds = now, np.abs(now - rank).sum(), rounds + 1
        assert 0 < rounds < 100
        got = {r.id: r["rank"] for r in traverse.pagerank(n, e, tolerance=tolerance).collect()}
        assert [got[x] for x in ids] == pytest.approx(list(rank), abs=1e-12)


def test_trails_use_an_edge_once(spark):
    _, e = graph(spark, [("aa", "R1", "bb"), ("bb", "R1", "aa"), ("aa", "R2", "bb"), ("bb", "R1", "cc"), ("aa", "R1", "aa")])
    rows = sorted(((r.edge_seq, r.src, r.dst) for r in e.collect()))
    want = []
    for k in (1, 2, 3):
        for used in itertools.permutations(rows, k):
            if used[0][1] == "aa" and used[-1][2] == "bb" and all(x[2] == y[1] for x, y in itertools.pairwise(used)):
                want.append((k, [x[0] for x in used], ["aa", *[x[2] for x in used]]))
    want.sort()
    assert len(want) > 4
    assert [r.path for r in traverse.trails(e, "aa", "bb", 3, 4).collect()] == [p for _, _, p in want[:4]]
    assert traverse.trails(e, "aa", "bb", 3, 100).count() == len(want)


def test_long_chains(spark):
    """Ids in the order 1, n, n - 1, ..., 2; and a path of more than 100 steps."""
    order = [1, *range(300, 1, -1)]
    ids = spark.createDataFrame([(i,) for i in [*order, 999]], "id long")
    hops = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(999, 12345)], "src long, dst long")
    got = {r.id: r.component for r in traverse.components(ids, hops).collect()}
    assert got == {i: 1 for i in order} | {999: 999}
    n, e = graph(spark, [(f"A{i:03}", "R1", f"A{i + 1:03}") for i in range(102)])
    far = traverse.bfs(e, n.where("id = 'a000'")).agg({"d": "max"}).first()[0]
    assert far == 102


def test_simple_paths_and_ego(spark):
    n, e = graph(spark, [("A1", "R1", "B1"), ("A1", "R2", "B1"), ("B1", "R1", "C1"), ("C1", "R1", "A1"), ("A1", "R1", "C1"), ("C1", "R1", "D1")])
    got = sorted("/".join(r.path) for r in traverse.simple_paths(e, "a1", "c1").collect())
    assert got == ["a1/b1/c1", "a1/b1/c1", "a1/c1"]
    nodes, edges = traverse.ego(n, e, n.where("id = 'b1'"), 1)
    assert {r.id for r in nodes.collect()} == {"b1", "c1"} and edges.count() == 1
    assert traverse.simple_paths(e, "a1", "nowhere").count() == 0


def test_threads(spark):
    n, e = graph(spark, [(f"A{i}", "R1", "Mid") for i in range(3)] + [("Mid", "R1", f"B{i}") for i in range(3)])
    got = reason.threads(n, e).collect()
    assert {t.name: t.importance for t in got}["Thread: mid"] == pytest.approx(0.3)
    assert [t.importance for t in got] == sorted((t.importance for t in got), reverse=True)
    assert any(t.name.startswith("Path: ") for t in got)
    assert all(len(t.nodes) >= 3 for t in got)


def test_dedup_threads_keeps_the_first(spark):
    rows = [(f"t{i}", [str(x) for x in range(10 + (i == 1))], [], 1.0, i) for i in range(3)] + [("u", ["a", "b", "c"], [], 0.1, 9)]
    df = spark.createDataFrame(rows, reason.THREAD)
    assert [r.name for r in reason.dedup_threads(df).orderBy("ord").collect()] == ["t0", "u"]


def test_recommendations(spark):
    n, e = graph(spark, [("Topic", "IS_A", "X1"), ("Topic", "USED_FOR", "Y1"), ("X1", "R1", "Z1"), ("Pre", "R1", "Topic"), ("Pre", "R1", "X1")])
    got = {r.concept: (round(r.priority, 6), r.difficulty) for r in recommend.recommend(n, e, "topic", interests=["Z"]).collect()}
    assert got == {"pre": (0.9, "easy"), "x1": (0.8, "medium"), "y1": (0.8, "medium"), "z1": (0.72, "medium")}
    known = spark.createDataFrame([("x1",)], "concept string")
    assert "x1" not in {r.concept for r in recommend.recommend(n, e, "topic", known).collect()}
    assert recommend.recommend(n, e, "unknown").count() == 0
    assert {r.concept for r in recommend.weak_areas(e, known).collect()} == {"topic", "pre"}
    assert len(recommend.recommend(n, e).collect()) == 5


def test_learning_path(spark):
    n, e = graph(spark, [("A1", "R1", "B1"), ("B1", "R1", "C1"), ("C1", "R1", "D1"), ("A1", "R1", "Z1")])
    got = recommend.learning_path(n, e, "D1").collect()
    assert [(r.concept, r.difficulty, r.priority) for r in got] == [("a1", "easy", 1.0), ("b1", "easy", 0.75), ("c1", "medium", 0.5), ("d1", "hard", 0.25)]
    assert got[0].estimated_time == "2.0 hours" and got[3].prerequisites == ["b1", "c1"] and got[0].prerequisites == [] and got[0].related == ["b1", "z1"]
    assert [r.concept for r in recommend.learning_path(n, e, "D1", ["c1", "a1"]).collect()] == ["c1", "d1"]
    assert recommend.learning_path(n, e, "A1", ["d1"]).count() == 0


def test_evaluation(spark):
    pred = triples(spark, [("a", "r", "1", 1), ("b", "r", "1", 1), ("c", "r", "1", 1), (" A", "R", "1 ", 1)])
    gold = triples(spark, [("b", "r", "1", 1), ("c", "r", "1", 1), ("d", "r", "1", 1)])
    s = evaluate.compare(pred, gold).first()
    assert (s.tp, s.fp, s.fn) == (2, 1, 1) and s.f1 == pytest.approx(2 / 3) and s.agreement == 0.5
    zero = evaluate.compare(pred.limit(0), gold.limit(0)).first()
    assert (zero.precision, zero.recall, zero.f1, zero.agreement) == (0, 0, 0, 0)
    named = triples(spark, [("neural network", "is_a", "model type", 1)])
    keyed = triples(spark, [("neural_network", "IS_A", "model_type", 1)])
    assert evaluate.compare(named, keyed, by_node=True).first().f1 == 1


def test_linking(spark):
    rows = [("ML", "m", 2, 1), ("Machine Learning", "m", 2, 3), ("Other", "-1", 1, 5), ("Else", "-1", 4, 7)]
    df = spark.createDataFrame(rows, "name string, cluster string, mentions long, seq long")
    mapping = link.canonical(df)
    assert {r.name: r.canonical for r in mapping.collect()} == {"ML": "Machine Learning", "Machine Learning": "Machine Learning", "Other": "Other", "Else": "Else"}
    t = triples(spark, [("ML", "IS_A", "Machine Learning", 1), ("ML", "IS_A", "Other", 1), ("Machine Learning", "IS_A", "Other", 1), ("Else", "IS_A", "New", 1)])
    assert {(r.subject, r.object) for r in link.relink(t, mapping).collect()} == {("Machine Learning", "Other"), ("Else", "New")}
    assert link.relink(t, mapping, parity=True).count() == 4
    assert [r.aliases for r in link.merge_clusters(df).collect()] == [["ML", "Machine Learning"]]


@pytest.mark.parametrize("method", ["agglomerative", "dbscan"])
def test_linking_of_names_by_their_vectors(spark, method):
    """Encode, cluster, canonical names, relink with the nearest for new names, against plain Python."""
    import numpy as np

    seen = [("Machine Learning", "USES", "Neural Network"), ("Machine Learnings", "USES", "Neural Networks"), ("Machine Learning", "IS_A", "Machinery"), ("Deep Neural Network", "IS_A", "Neural Network"), ("Machine", "IS_A", "Tool")]
    new = [("The Machine Learning", "USES", "Neural Network"), ("Machine Learning", "USES", "Quantum"), ("Machine Learnings X", "IS_A", "Machine Learning")]
    known, asked = (triples(spark, [(*t, 1.0) for t in x]) for x in (seen, new))
    names = [n for s, _, o in seen for n in (s, o)]
    distinct = list(dict.fromkeys(names))
    x = {n: np.array(link.hashed_vector(n), float) for n in distinct + [n for s, _, o in new for n in (s, o)]}
    groups = [{n} for n in distinct]
    mean = min if method == "dbscan" else lambda d: sum(d) / len(d)  # clusters of two and more: single linkage
    while len(groups) > 1:
        d, a, b = min((mean([1 - x[p] @ x[q] for p in g for q in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if d >= 0.3:
            break
        groups[a] |= groups.pop(b)
    to = {n: max(g, key=lambda m: (names.count(m), len(m), -names.index(m))) for g in groups for n in g}
    assert to["Machine Learnings"] == "Machine Learning" and to["Machinery"] == ("Machinery" if method == "agglomerative" else "Machine Learning")
    for n in set(x) - set(to):
        best = max(distinct, key=lambda m: x[n] @ x[m])
        to[n] = to[best] if x[n] @ x[best] >= 0.7 else n
    assert to["The Machine Learning"] == "Machine Learning" and to["Quantum"] == "Quantum"
    for part, rows, source in ((known, seen, None), (asked, new, known)):
        want = {(to[s], r, to[o]) for s, r, o in rows if to[s] != to[o]}
        assert sorted(map(tuple, link.link(part, 0.7, method, known=source).select("subject", "relation", "object").collect())) == sorted(want)


def test_clusters(spark):
    import math

    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(1, at(0)), (2, at(20)), (3, at(40)), (4, at(90)), (5, at(180)), (6, at(181))]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {r.id: r.cluster for r in link.dbscan(df, 0.07).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: -1, 5: 5, 6: 5}
    aver = {r.id: r.cluster for r in link.agglomerative(df, 0.07).collect()}
    assert aver[5] == aver[6] == 5 and aver[4] == 4 and len({aver[1], aver[2], aver[3]}) == 2  # average of 20 and 40 degrees is too far
    strict = {r.id: r.cluster for r in link.dbscan(df, 0.07, 3).collect()}
    assert strict == {1: 2, 2: 2, 3: 2, 4: -1, 5: -1, 6: -1}
    stats = link.link_statistics(link.dbscan(df, 0.07)).first()
    assert (stats.total_entities, stats.num_clusters, stats.singletons) == (6, 3, 1)
    monkey = link.agglomerative(df, 0.07, most_members=1)
    assert {r.linkage for r in monkey.where("id = 1").collect()} == {"single"}


def test_average_linkage_of_large_components(spark, monkeypatch):
    """Rounds of nearest clusters in blocks give what merging the closest two in turn gives."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(30, 8)) * 0.6 for c in rng.normal(size=(5, 8))])
    df = spark.createDataFrame([(i * 7 % 151, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    ids = np.array([i * 7 % 151 for i in range(len(x))])
    order = np.argsort(ids)
    want = dict(zip(ids[order].tolist(), link.average_linkage(x[order], ids[order], 0.4).tolist(), strict=True))
    assert 5 < len(set(want.values())) < 60
    monkeypatch.setattr(link, "BLOCK", 40)
    for most in (4000, 60, 0):
        monkeypatch.setattr(link, "MOST_MEMBERS", most)
        got = link.agglomerative(df, 0.4).collect()
        assert {r.id: r.cluster for r in got} == want and {r.linkage for r in got} == {"average"}


def test_dense_rounds_keep_no_pairs(spark, monkeypatch):
    """Rounds over blocks give the tree without pairs of rows; copies and vectors without a length do no harm."""
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(size=(25, 6)) * 0.5 for c in rng.normal(size=(4, 6))])
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0), x[1:2] * 2, x[1:2] * (1 + 1e-9 * rng.normal(size=(30, 6)))])
    rows = [(i * 5 % 977, v.tolist()) for i, v in enumerate(x)]
    ids = np.array([i for i, _ in rows])
    order = np.argsort(ids)
    want = dict(zip(ids[order].tolist(), link.average_linkage(x[order], ids[order], 0.4).tolist(), strict=True))
    odd = {1001: [0.0] * 6, 1002: None, 1003: [float("nan")] * 6, 1004: []}
    df = spark.createDataFrame(rows + list(odd.items()), "id long, vec array<double>")
    monkeypatch.setattr(link, "similar_pairs", None)  # would keep all close pairs
    for most, block in ((4000, 2048), (30, 7)):
        monkeypatch.setattr(link, "MOST_MEMBERS", most)
        monkeypatch.setattr(link, "BLOCK", block)
        got = link.agglomerative(df, 0.4).collect()
        assert {r.id: r.cluster for r in got} == want | {i: i for i in odd} and len(got) == len(rows) + 4
    assert link.agglomerative(df.where("id > 1000"), 0.4).count() == 4


def test_pairs_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if u[i] @ u[j] >= 0.5}
    for block in (2048, 7):
        monkeypatch.setattr(link, "BLOCK", block)
        got = link.similar_pairs(df, 0.5).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_approximate_pairs_find_most(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres, 5, axis=0) + 0.15 * rng.normal(size=(100, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    want = {(r.a, r.b) for r in link.similar_pairs(df, 0.9).collect()}
    got = {(r.a, r.b) for r in link.approximate_pairs(df, 0.9).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_search_scores(spark):
    import math

    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, math.sqrt(1 - 0.81)]), (3, [0.0, 1.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, qvec array<double>")
    l2 = {r.id: round(r.score, 6) for r in retrieve.search(index, asked, 3).collect()}
    assert l2 == {1: 1.0, 2: 0.8, 3: -1.0}
    cos = {r.id: round(r.score, 6) for r in retrieve.search(index, asked, 3, "cosine").collect()}
    assert cos[2] == 0.9
    assert [r.id for r in retrieve.retrieve(index, asked, 2, 0.85, "l2sq").collect()] == [1]
    with pytest.raises(ValueError):
        retrieve.search(index, spark.range(1001).selectExpr("id as query_id", "array(1d, 0d) as qvec"))


def test_search_in_blocks(spark, monkeypatch):
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "id long, vec array<double>")
    asked = spark.createDataFrame([(q, [1.0, q / 10]) for q in range(20)] + [(0, [0.0, 1.0]), (99, None)], "query_id long, qvec array<double>")
    want = retrieve.search(index, asked, 3, "cosine").collect()
    monkeypatch.setattr(retrieve, "MOST_QUERIES", 7)
    assert sorted(retrieve.retrieve(index, asked, 3, -1.0, "cosine").collect()) == sorted(want) and len(want) == 60


def test_hashed_vectors():
    a, b, c = (link.hashed_vector(t) for t in ("neural network", "neural networks", "zzz"))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, a) == pytest.approx(1, abs=1e-5) and dot(a, b) > 0.8 > dot(a, c)


def test_plans_push_filters_and_cut_early(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = extract.triples(extract.chunks(docs))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "SortMergeJoin" not in plan
    n, e = graph(spark, random_graph(5))
    top = G.top_degree(n, e)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
