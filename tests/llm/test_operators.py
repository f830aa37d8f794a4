"""The ten operators against plain Python on small documents."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("loomgraph.llm")

from loomgraph.llm import components, langid, media, mixing, ngram_join, packing, quality, sharding, substring, token_count, tokens, topk_search  # noqa: E402
from tests.llm.helpers import DOCS, corpus, words  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns named like inner ones."""
    from pyspark.sql import functions as F

    for name in ("node", "root", "rank", "size", "arc", "frag", "text_", "cut_id", "cut_key", "key", "m", "base", "first_id", "mix_id", "mix_times", "TEXT2", "score", "other_1", "c0"):
        df = df.withColumn(name, F.lit("x"))
    return df


# 1 ----------------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(160)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (550, [float("inf"), 0.0, 0.0, 0.0]), (600, []), (650, [0.5, 0.5]), (None, [1.0] * 4)]
    rows += [(7, [1.0, 1.0, 1.0, 1.0])] * 2
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        qv = min(v for i, v in good if i == q)
        ranked = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)[:5]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)}
    for size in (8192, 2):
        got = topk_search.top_k(df, pass_rows=size).collect()
        assert {tuple(r) for r in got} == expected
        assert len(got) == len(expected)


def test_weights_too_large_for_scores_are_refused(spark):
    df = spark.createDataFrame([(0, [3e15]), (1, [2e15]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk_search.top_k(df).collect()


def test_top_k_with_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(one).collect() == []
    assert topk_search.top_k(one.limit(0)).collect() == []
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.rank, r.vec_id) for r in topk_search.top_k(three).collect()} == {(0, 1, 50), (0, 2, 1), (50, 1, 1), (50, 2, 0)}


# 2 ----------------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, (d, t, *_) in enumerate(rows):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return Counter((rows[i][0], len(sets[i]), min(rows[j][0] for j in g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = corpus(seed, 90)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = ngram_join.similar(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_ngram_join_of_near_copies_with_hot_shingles(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w), None, None, 0))
    got = ngram_join.similar(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


@pytest.mark.parametrize("spread", [3, 9])
def test_pairs_grow_with_a_group_of_near_copies_and_not_with_its_square(spark, monkeypatch, spread):
    """Copies with some changed words link with the middle of the group (spread
    3) or most with none (spread 9), hardly ever with each other."""
    counted, real = [], ngram_join.overlaps

    def overlaps(pairs, *more):
        counted.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(ngram_join, "overlaps", overlaps)
    totals = []
    for n in (100, 400):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(120)]
        rows = []
        for i in range(n):
            w = list(base)
            for at in rng.sample(range(120), rng.randint(0, spread)):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(w), None, None, 0))
        counted.clear()
        got = ngram_join.similar(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
        totals.append(sum(counted))
    assert totals[1] < 8 * totals[0] and totals[1] < 400 * 12


@pytest.mark.parametrize("kind", ["one", "unlike", "long", "alone"])
def test_ngram_join_where_batches_share_nothing(spark, monkeypatch, kind):
    """One row, rows that share nothing, one long text of its own beside copies,
    and batches (of a document each) without a shared shingle."""
    own = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdefghij"]
    texts = {"one": own[:1], "unlike": own, "long": [" ".join(f"w{i}" for i in range(30_000)), own[0], own[0] + " more"], "alone": [None, "", *own, own[3] + " more"]}[kind]
    monkeypatch.setattr(ngram_join, "BATCH_SHINGLES", 20)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(4, "doc_id")
    got = ngram_join.similar(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert sorted(r.doc_id for r in ngram_join.keep_first(df).collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_fragments_dealt_in_several_stages(spark, docs):
    rows, df = docs
    got = ngram_join.similar(df, fan=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(4), fan=2).collect()
    assert Counter(map(tuple, got)) == brute_substrings(rows)


def test_keep_first_keeps_one_of_each_group_and_all_columns(spark, docs):
    rows, df = docs
    extra = clashing(df)
    kept = ngram_join.keep_first(extra)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_keep_first_of_repeated_ids(spark):
    """An id with several texts: each is judged by its own set."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, a + " more"), (8, c), (5, a), (9, None), (9, ""), (9, c + " x"), (4, a.replace("a0", "z")), (6, b), (None, b), (None, "one of its own")]
    kept = ngram_join.keep_first(clashing(spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS).repartition(3)))
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(3, b), (4, a.replace("a0", "z")), (7, c), (9, ""), (0, "one of its own")])
    alone = spark.createDataFrame([(5, t, None, None, 0) for t in (a, b, b + " more", a.upper())], DOCS)
    got = [r.text for r in ngram_join.keep_first(alone).collect()]
    assert len(got) == 2 and {t[0].lower() for t in got} == {"a", "b"}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000}


# 3 ----------------------------------------------------------------------

@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(spark, docs, shards):
    rows, df = docs
    got = sharding.shard_rows(clashing(df), shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_shard_of_each_row_is_recomputed(spark, docs):
    """The ring in plain Python: rows by position, full shards passed clockwise."""
    from pyspark.sql import functions as F

    rows, df = docs
    spots = sharding.ring(3)
    at = df.select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("s"))
    at = at.select("*", F.shiftrightunsigned(F.xxhash64("doc_id", "c", "s"), 32).alias("p")).collect()
    order = sorted((next((i for i, (x, _) in enumerate(spots) if x >= r.p), 0), r.p, r.doc_id, r.c, r.s) for r in at)
    room = [len(rows) // 3] * 3
    for shard in list(dict.fromkeys(o for _, o in spots))[: len(rows) % 3]:
        room[shard] += 1
    own, over = {}, []
    for arc, *row in order:
        shard = spots[arc][1]
        if room[shard]:
            room[shard] -= 1
            own[tuple(row[1:])] = shard
        else:
            over.append((arc, row))
    for arc, row in over:
        while not room[spots[arc][1]]:
            arc = (arc + 1) % len(spots)
        room[spots[arc][1]] -= 1
        own[tuple(row[1:])] = spots[arc][1]
    got = {(r.doc_id, r.text_crc32, r.size): r.shard for r in sharding.shard_rows(df, 3).collect()}
    assert got == own


def test_many_equal_rows(spark, monkeypatch):
    """A third of all rows is one row again and again: no group of them meets in one task."""
    from pyspark.sql import functions as F

    n, text = 40_000, "one two three"
    df = spark.range(3 * n).select(F.when(F.col("id") < n, F.lit(None).cast("long")).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"), F.lit(None).cast("string").alias("lang"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    got = sharding.shard_rows(df, 8)
    by = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 == 3 * n // 8 for r in by) and len(by) == 8
    mixed = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in mixed) == 3 * n and sum(r.taken for r in mixed) == pytest.approx(9 * n, abs=4)
    blocks = []
    real = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda d, label, *a: (out := real(d, label, *a), blocks.append(out.agg(F.max(F.size("s.done"))).first()[0]) if "level" in label else None)[0])
    out = mixing.apply_mix(df).groupBy("source").count().collect()
    assert sum(r["count"] for r in out) == pytest.approx(3 * n, abs=2)
    assert max(blocks) < 4 * mixing.FANOUT
    labels = spark.createDataFrame([(n + 1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(df, labels).where("selected").count() == 3 * n // 2


def test_ring_overflow_goes_clockwise():
    owners = [0, 1, 2]
    plan = sharding.place_counts([6, 0, 0], owners, 3)
    assert plan == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 6, 2, 0)]
    assert sharding.place_counts([0, 0, 0], owners, 3) == []
    moved = sharding.ring(9)
    assert [p for p in sharding.ring(8) if p not in moved] == []  # a further shard only adds nodes


# 4 ----------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_meets_targets(spark, docs):
    rows, df = docs
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    targets = brute_targets(sizes)
    got = mixing.mix(clashing(df)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(words(t))) for d, t, *_ in rows)
    taken, facts = defaultdict(int), defaultdict(set)
    source = defaultdict(list)
    for d, t, _, s, _ in rows:
        source[d, len(words(t))].append(s)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if len(source[r.doc_id, r.size]) == 1:
            s = source[r.doc_id, r.size][0]
            taken[s] += r.taken
            facts[s].add((r.source_size, round(r.target, 6)))
    assert all(len(v) == 1 for v in facts.values())
    for s, ((size, target),) in facts.items():
        assert size == sizes[s] and target == pytest.approx(targets[s], rel=1e-9)
        assert abs(taken[s] - target) <= 1.5
    again = mixing.mix(df.repartition(2)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_targets_of_many_sources_in_ranges(spark, monkeypatch):
    from loomgraph.llm import common

    monkeypatch.setattr(common, "RANGE_ROWS", 40)
    rng = random.Random(9)
    sizes = {(f"host{i:04}" if i else None): rng.choice([0, 1, 5, 200, rng.randrange(10_000)]) for i in range(300)}
    rows = [(s, x) for s, n in sizes.items() for x in (n // 3, n - n // 3)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()
    want, order = brute_targets(sizes), sorted(sizes, key=lambda s: (s is None, s))
    assert {r.source: (r.source_size, r.n, r.sid) for r in got} == {s: (sizes[s], 2, i) for i, s in enumerate(order)}
    assert all(r.target == pytest.approx(want[r.source], rel=1e-9) for r in got)


def test_mixing_runs_no_python(spark, docs):
    plan = mixing.mix(docs[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixing_of_nothing(spark, empty):
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 1)], DOCS)
    assert [(r.taken, r.target) for r in mixing.mix(blank).orderBy("doc_id").collect()] == [(0, 0.0), (0, 0.0)]


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FANOUT", 4)
    rows = [(i, "w " * (i % 9 + 1), None, "s" if i % 3 else "t", 0) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 200
    for size, target in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if r.source_size == size) - target) <= 1.5


# 5 ----------------------------------------------------------------------

def test_media_round_trip(spark, docs):
    rows, df = docs
    long = [(9001, "abc " * 20000, None, None, 0), (9002, "abc " * 20000 + "end", None, None, 0), (None, "abc " * 20000, None, None, 0)]
    rows = rows + long
    got = media.media_columns(clashing(df.unionByName(spark.createDataFrame(long, DOCS)))).collect()
    expected = Counter()
    for d, t, *_ in rows:
        n, raw = media.payload(t)
        assert len(raw) % 64 == 0 and len(raw) > 0
        wav = media.to_wav(raw)
        expected[d, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), media.feature(raw)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == expected


def test_store_holds_each_chunk_once(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdef ") for _ in range(30000))
    rows = [(i, body[: 20000 + 100 * i], None, None, 0) for i in range(8)]
    files = media.store(spark.createDataFrame(rows, DOCS))
    kept = [c.digest for f in files.collect() for c in f.chunks if c.bytes is not None]
    assert len(kept) == len(set(kept))
    assert sum(len(f.chunks) for f in files.collect()) > 2 * len(kept)


def test_chunks_join_to_the_data_and_survive_an_insert():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(100_000))
    assert b"".join(media.chunks(data)) == data
    assert all(len(c) <= media.MOST for c in media.chunks(data))
    other = media.chunks(data[:50_000] + b"!" + data[50_000:])
    assert len(set(other) & set(media.chunks(data))) >= len(other) - 3
    assert media.chunks(b"") == [b""]


def test_damaged_media_are_noticed(spark):
    from pyspark.sql import functions as F

    files = media.store(spark.createDataFrame([(1, "some text", None, None, 0)], DOCS))
    bad = files.withColumn("media_sha256", F.lit("0" * 64))
    real = media.store
    try:
        media.store = lambda *a: bad
        with pytest.raises(Exception, match="do not match"):
            media.media_columns(bad).collect()
    finally:
        media.store = real


def test_copies_of_a_lent_chunk_are_made_by_several_tasks(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    rows = [(i, passage + f" {i}" * (i % 5), None, None, 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    want = Counter(map(tuple, media.media_columns(df).collect()))
    monkeypatch.setattr(media, "REFERENCES_EACH", 2)
    monkeypatch.setattr(media, "LENT_EACH", 3)
    files = media.store(df)
    assert max(c.salts for r in files.select("chunks").collect() for c in r.chunks) > 6
    assert Counter(map(tuple, media.media_columns(df).collect())) == want and len(want) == 60


# 6 ----------------------------------------------------------------------

ODD = ["don't we'll I'M 42 1234 x_y __ !?", "a<|startoftext|>b<|endoftext|>", "Größe ÀÉ ǅ İstanbul ﬁ ½ ² ª", "日本語 текст עברית", "é     \x1c \x85 x", "\x00a\x07", "😀👍🏽 ok", "tab\there\r\nline", ""]


def test_token_counts_equal_the_library(spark, docs):
    rows, df = docs
    odd = [(20000 + i, t, None, None, 0) for i, t in enumerate(ODD)] + [(None, "no id", None, None, 0), (5, "word " * 3000, None, None, 0)]
    rows = rows + odd
    tok = tokens.library("word_bpe_49k.json")
    expected = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for d, t, *_ in rows)
    got = token_count.count_tokens(clashing(df.unionByName(spark.createDataFrame(odd, DOCS)))).collect()
    assert Counter(map(tuple, got)) == expected


def test_token_counts_of_batches_in_groups(spark, docs, monkeypatch):
    for name, size in (("FAN", 3), ("DOCS_EACH", 50), ("BATCH_WORDS", 2000), ("BATCH_DOCS", 20)):
        monkeypatch.setattr(token_count, name, size)
    rows, df = docs
    tok = tokens.library("word_bpe_49k.json")
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(df).collect()}
    assert got == {(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for d, t, *_ in rows}


# 7 ----------------------------------------------------------------------

def brute_substrings(rows, k=20):
    first = {}
    places = sorted((d, s, i) for i, (d, t, *_) in enumerate(rows) for s in range(len(words(t)) - k + 1))
    split = [words(t) for _, t, *_ in rows]
    gone = defaultdict(set)
    for d, s, i in places:
        key = tuple(split[i][s : s + k])
        if first.setdefault(key, (d, s)) != (d, s):
            gone[i].update(range(s, s + k))
    return Counter((rows[i][0], len(w), len(gone[i]), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone[i]).encode()).hexdigest()) for i, w in enumerate(split))


@pytest.mark.parametrize("seed", [1, 4])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed, 80)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = substring.dedup_substrings(clashing(spark.createDataFrame(rows, DOCS).repartition(4))).collect()
    assert Counter(map(tuple, got)) == brute_substrings(rows)


def test_substring_dedup_within_one_document_and_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    run = " ".join(f"r{i}" for i in range(25))
    rows = [(4, "a b " + run + " c " + run + " d", None, None, 0), (2, run + " z", None, None, 0), (9, "q " * 60, None, None, 0), (11, "short", None, None, 0)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, got)) == brute_substrings(rows)


def test_substring_dedup_of_ids_that_repeat(spark):
    """Rows of one id and different texts are documents of their own; null
    ids and the least id there is stay what they are; equal rows are one."""
    least = -(1 << 63)
    runs = ["a " * 50, "b " * 50, " ".join(f"c{i}" for i in range(30)), " ".join(f"d{i}" for i in range(30))]
    rows = [(1, runs[0]), (1, runs[1]), (5, runs[2]), (5, "x " + runs[2]), (7, runs[3]), (7, runs[3]), (None, "n " * 21), (least, "m " * 21), (2, "m " * 20)]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS).repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_substrings(df).collect())
    assert sum(got.values()) == 9
    first = [(1, 50, 49)] if got[(1, 50, 49)] else []
    assert len(first) and got[(1, 50, 49)] == 2  # neither is cut at the other's places
    assert got[(7, 30, 0)] == 2 and got[(None, 21, 20)] == 1 and got[(least, 21, 20)] == 1 and got[(2, 20, 20)] == 1
    assert got[(5, 30, 0)] + got[(5, 31, 0)] == 1 and got[(5, 30, 30)] + got[(5, 31, 30)] == 1
    assert len(substring.strip_repeats(df).collect()) == 7 + (got[(5, 31, 30)] == 1)


def test_strip_repeats_keeps_columns(spark, docs):
    rows, df = docs
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    out = substring.strip_repeats(df)
    assert out.columns == df.columns
    counts = {d: (n, gone) for d, n, gone, _ in brute_substrings(rows)}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == {d for d, (n, gone) in counts.items() if n > gone or not gone}
    for d, text in kept.items():
        n, gone = counts[d]
        assert len(words(text)) == n - gone
        if not gone:
            assert text == rows[d][1]


# 8 ----------------------------------------------------------------------

@pytest.mark.parametrize("block", [1_000_000, 3000])
def test_packing_covers_every_id_once(spark, docs, block):
    rows, df = docs
    odd = [(20000 + i, t, None, None, 0) for i, t in enumerate([*ODD, "long text " * 4000, "<|endoftext|> x"])]
    rows = [(i, t) for i, (_, t, *_) in enumerate(rows + odd)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(2)
    tok = tokens.library("byte_bpe_50k.json")
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.pack(clashing(df), block_tokens=block).collect()
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, p in pieces.items():
        at = 0
        for start, length in sorted(p):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(pieces) == set(ids)
    used = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    assert 2048 * len(seqs) - used < 2048 * 2  # less than one sequence of padding in each partition


def test_costly_pieces_go_to_the_cheapest_sequence():
    placed, over = packing.assign([6, 5, 3, 2], 8, False)
    assert sum(p[2] for p in placed) == 16 and not over
    by = defaultdict(int)
    for _, _, n, s, _ in placed:
        by[s] += n
    assert set(by.values()) == {8}
    placed, over = packing.assign([3], 8, False)
    assert placed == [] and over == [(0, 0, 3)]
    assert packing.assign([], 8, True) == ([], [])


# 9 ----------------------------------------------------------------------

def test_resampling_prefers_text_like_the_target(spark):
    rng = random.Random(1)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(5, 30))), None, None, 0) for i in range(200)] + [(900, None, None, None, 0), (901, "", None, None, 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    got = quality.resample(clashing(df), labels, keep=0.5).collect()
    chosen = {r.doc_id for r in got if r.selected}
    assert len(got) == 202 and len(chosen) == 101
    assert sum(i % 2 for i in chosen) >= 80
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in sorted(got, key=lambda r: (-r.key, r.doc_id))[:101]}
    again = quality.resample(df.repartition(3), labels, keep=0.5).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    assert [r.log_weight for r in got if r.doc_id >= 900] == [0.0, 0.0]
    assert len(quality.resample(df, labels.limit(0), keep=1.0).where("selected").collect()) == 202


def test_equal_and_nameless_rows_draw_each_their_own_noise(spark):
    """Rows without an id, rows that repeat one, and equal rows."""
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    texts = [f"some words {i}" for i in range(30)]
    rows = [(None, t, None, None, 0) for t in texts] + [(7, t, None, None, 0) for t in texts] + [(8, "same text", None, None, 0)] * 300 + [(None, None, None, None, 0)] * 20
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = quality.resample(df, labels).collect()
    assert len(got) == len(rows) and sum(r.selected for r in got) == len(rows) // 2
    assert len({round(r.key - r.log_weight, 9) for r in got}) == len(rows)
    copies = [r for r in got if r.doc_id == 8]
    assert len(copies) == 300 and 0 < sum(r.selected for r in copies) < 300
    assert {tuple(r) for r in quality.resample(df.repartition(2), labels).collect()} == {tuple(r) for r in got}


def test_log_weights_are_recomputed(spark, docs):
    """The two models from plain counts, every weight and every selection from them."""
    rows, df = docs
    hashes = quality.WordHashes()
    good = {d for i, (d, *_) in enumerate(rows) if i % 3 == 0}
    labels = spark.createDataFrame([(d, 1, 0) for d in sorted(good)], "doc_id long, quality int, toxic int")
    target, raw = Counter(), Counter()
    for d, t, *_ in rows:
        grams = quality.grams(t or "", hashes).tolist()
        raw.update(grams)
        if d in good:
            target.update(grams)
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + quality.BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + quality.BUCKETS)) for b in range(quality.BUCKETS)]
    expected = Counter((d, len(g), round(sum(ratio[b] for b in g), 6)) for d, t, *_ in rows for g in [quality.grams(t or "", hashes).tolist()])
    got = quality.resample(df, labels, keep=0.3).collect()
    assert Counter((r.doc_id, r.n_grams, round(r.log_weight, 6)) for r in got) == expected
    assert all(r.mean_ratio == pytest.approx(r.log_weight / r.n_grams if r.n_grams else 0.0) for r in got)
    need = math.ceil(0.3 * len(rows))
    assert Counter(r.doc_id for r in got if r.selected) == Counter(r.doc_id for r in sorted(got, key=lambda r: (-r.key, r.doc_id))[:need])


def test_the_edge_of_a_sample_is_found_in_turns(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANKED", 3)
    monkeypatch.setattr(quality, "BINS", 4)
    rng = random.Random(4)
    keys = [rng.choice([-1.0, 1.0]) * 10 ** rng.uniform(-3, 7) for _ in range(300)] + [5.0] * 20
    rows = spark.createDataFrame([(k,) for k in keys], "key double")
    for left in (1, 57, 200, 320):
        low, high, rest, n = quality._edge(rows, min(keys), max(keys), left, len(keys))
        ordered = sorted(keys, reverse=True)
        assert low <= ordered[left - 1] <= high and left - rest == sum(k > high for k in keys)
        assert n == sum(low <= k <= high for k in keys) and (n <= 3 or low == high)


def test_quality_ranks_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    score = {r.doc_id: r.mean_ratio for r in quality.resample(docs, train).collect()}
    good, bad = ([score[d] for d, q in test.items() if q == x and d in score] for x in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.6


# 10 ---------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_posteriors_are_recomputed(spark, docs):
    """Counts, smoothing, prior and posterior in plain Python, n-gram by n-gram."""
    rows, df = docs

    def bucket(gram):
        h = 0x811C9DC5 + len(gram)
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
        return h % langid.BUCKETS

    def grams(t):
        t = f"\n{t.lower()}\n"
        return Counter(bucket(t[i : i + n]) for n in langid.ORDERS for i in range(len(t) - n + 1))

    learned = [(t, lang) for d, t, lang, *_ in rows if zlib.crc32(str(d).encode()) % 4 != 2 and lang and t is not None]
    model = {}
    for lang in {x for _, x in learned}:
        own = sum((grams(t) for t, x in learned if x == lang), Counter())
        model[lang] = (own, sum(own.values()) + 0.5 * langid.BUCKETS, math.log(sum(x == lang for _, x in learned) / len(learned)))
    for r in langid.identify(df).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {x: prior + sum(n * math.log((own[b] + 0.5) / total) for b, n in grams(text).items()) for x, (own, total, prior) in model.items()}
        best = max(logs.values())
        score = 1 / sum(math.exp(v - best) for v in logs.values())
        assert r.score == pytest.approx(score, abs=1e-3) and logs[r.lang_pred] == pytest.approx(best, abs=1e-2)


def test_pieces_of_a_very_long_text_lose_no_gram(monkeypatch):
    text = "Grüße an " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert (langid.counts(text) == whole).all()


def test_language_edges(spark, empty):
    assert langid.identify(empty).collect() == []
    rows = [(1, "the cat", "en", None, 0), (3, "le chat", "fr", None, 0), (5, None, "en", None, 0), (6, "123 ...", "fr", None, 0), (7, "", None, None, 0), (None, "le chat", None, None, 0), (8, "x" * 3_000_000, None, None, 0)]
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in langid.identify(clashing(spark.createDataFrame(rows, DOCS))).collect()}
    assert [got[d][:2] for d in (5, 6, 7)] == [("und", 0.0)] * 3
    assert got[None][0] == "fr" and got[None][2] is False and got[8][0] in ("en", "fr")
    unlabelled = spark.createDataFrame([(1, "words", None, None, 0)], DOCS)
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"
    kept = langid.keep_identified(clashing(spark.createDataFrame(rows, DOCS)))
    assert kept.columns == clashing(spark.createDataFrame(rows, DOCS)).columns
    assert {r.doc_id for r in kept.collect()} <= {1, 3, None, 8}


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than a block of the model has: predictions do not change."""
    said = {"cs": "žluťoučký kůň", "en": "the cat sat on the mat", "fr": "le chat du château", "ja": "ぁあぃいぅうぇえ", "ru": "быстрая лиса"}
    df = spark.createDataFrame([(10 * i + j, text, lang, None, 0) for i, (lang, text) in enumerate(said.items()) for j in range(6)], DOCS)
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert {d: x for d, (x, _) in got.items()} == {10 * i + j: lang for i, lang in enumerate(said) for j in range(6)}
    assert got == {d: (x, pytest.approx(s)) for d, (x, s) in whole.items()}


def test_rare_languages_are_learned(spark):
    """The sample takes few rows among many whole, those of one id too."""
    rows = [(i, "the cat sat on the mat", "en", None, 0) for i in range(0, 6000, 2)] + [(10_001 + 2 * i, "žluťoučký kůň", "cs", None, 0) for i in range(4)]
    rows += [(None, "ぁあぃいぅうぇえ", "ja", None, 0)] * 3
    got = {(r.doc_id or 0) > 10_000 and "cs" or (r.doc_id is None and "ja" or "en"): r.lang_pred for r in langid.identify(spark.createDataFrame(rows, DOCS), train_rows=30).collect()}
    assert got == {"cs": "cs", "en": "en", "ja": "ja"}


# all --------------------------------------------------------------------

def test_empty_tables_give_empty_results(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (sharding.shard_rows, media.media_columns, token_count.count_tokens, substring.dedup_substrings, packing.pack, ngram_join.similar, ngram_join.keep_first, substring.strip_repeats, mixing.apply_mix, langid.keep_identified):
        assert f(empty).collect() == []
    assert quality.resample(empty, labels).collect() == []
