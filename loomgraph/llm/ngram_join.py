"""Exact Jaccard self-join of shingle sets by vertical partitioning.

Shingles are hashed and the order of hashes is cut into fragments.  A first
pass counts, fragment by fragment, in how many different sets each shingle
is, and returns to each set the shingles it shares; a set with less than the
threshold shared cannot link and leaves.  The rest are ordered by (document
frequency, hash), so that prefixes hold the rarest shared shingles.

Sets that meet in a prefix shingle are compared with two hubs of that shingle
first, one of them the set whose shingles are the commonest, which is in the
middle of a group of near copies: that needs a number of pairs linear in the
group.  Linked sets form components.  Such rounds are repeated, with other
hubs, while they lessen the pairs of different components that meet; what is
left of those is compared pair by pair, so no link is lost and no group of
copies is expanded.  Parity signatures bound the overlap of a pair from above
and spare most comparisons of pairs that cannot link.  A comparison counts
partial overlaps in each vertical fragment of the two sets separately and sums
them per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Packed, WordHashes, columns, cut, fragments, mix, rolling, shield, stages, starts, texts, trim
from loomgraph.llm.components import components

WORDS = 5
#: Similarity threshold in percent.
PERCENT = 75
#: Pairs to look at for each set and shingle up to which no more star rounds are worth while, and the share of the pairs that a
#: round must leave at most to be followed by another.
LINEAR, FALL = 64, 0.8
#: Hubs of the largest component of a shingle in a later star round.
HUBS = 16
#: Vertical fragments of the overlap count.
VERTICAL = 4
#: Words of the parity signature of a set, and of the shorter one, folded from it, that goes along with prefix shingles.
SIGNATURE, FOLDED = 32, 8
SIGNS = tuple(f"s{i}" for i in range(SIGNATURE))
FEW = tuple(f"f{i}" for i in range(FOLDED))
#: Rows (of two or three numbers) up to which a side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Pairs that one task counts, about; with them come at most twice as many sets.
PAIRS_EACH = 20_000
#: Shingles of one fragment of their order, about.
SHINGLES_EACH = 1_000_000
#: Shingles that a task gathers before it sends them to their fragments.
BATCH_SHINGLES = 250_000
#: Sets of one batch that make a shingle hot, and the document frequency that stands for all hot ones.
HOT, MOST_FREQ = 32, (1 << 31) - 1


def shingles(text: str | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, ASCII case folded."""
    words = hashes.of((text or "").encode().lower().split())
    return np.unique(rolling(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a set: documents with one set are one node."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets(df: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, node, n) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [(node_of(s), len(s)) for s in (shingles(t, hashes, k) for t in texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                names=["doc_id", "node", "n"],
            )
            trim()

    return df.mapInArrow(run, "doc_id long, node long, n long")


#: The sets of a batch, which is named by a hash of what it holds: where each is in it, and its size.
SETS = {"batch": np.uint64, "spot": np.uint32, "node": np.int64, "size": np.uint32}
#: What goes back to a batch: a shingle that one of its sets shares, with its document frequency.
BACK = Packed({"home": np.uint64, "place": np.uint32, "shingle": np.uint64, "freq": np.uint32}, SETS)
#: A shingle of a set on its way to the others', and what a batch can send back by itself.  The hash's upper 48 bits
#: stand for a shingle; ``hot`` marks one that some batch has found in HOT sets or more.
BOTH = Packed({"token": np.uint64, "from": np.uint64, "at": np.uint32, "hot": np.uint8}, *BACK.groups)
LOW16 = np.uint64((1 << 16) - 1)


def shared_shingles(df: DataFrame, n_frag: int, k: int = WORDS, percent: int = PERCENT, fan: int | None = None) -> DataFrame:
    """(node, n, m, central, tokens, s0...) of the sets that share at least
    ``percent`` of their shingles with other sets: size, number of shared
    shingles, how common its shingles are on average (high for a set in the
    middle of its group), the shared ones sorted by (document frequency,
    token), and their parity signature.

    A shingle that HOT sets of one batch hold counts as the commonest of all
    everywhere: a batch settles it for its own sets and sends it on once, so
    that no fragment gets all sets of a very common shingle.  A set that is in
    several batches counts once in each: that is taken off its own shingles in
    the end, and an order of shingles is the same for all sets in any case.
    """
    plan = stages(n_frag, fan)
    fields = "node long, n long, m long, central double, tokens array<long>, " + ", ".join(f"{s} long" for s in SIGNS)

    def settle(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = np.array(sorted(held), np.int64)
        sizes = np.array([len(held[x]) for x in nodes.tolist()], np.uint32)
        token = np.concatenate([held[x] for x in nodes.tolist()]) & ~LOW16
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), sizes)
        known, code, times = np.unique(token, return_inverse=True, return_counts=True)
        hot = times >= HOT
        here = hot[code]
        name = np.uint64(xxhash.xxh3_64_intdigest(nodes.tobytes()))
        # a hot one is sent once, without the sets, whose return is settled here
        rest, more = int((~here).sum()), int(hot.sum())
        send = {"token": np.r_[token[~here], known[hot]], "from": np.full(rest + more, name), "at": np.r_[owner[~here], np.zeros(more, np.uint32)], "hot": np.repeat(np.array([0, 1], np.uint8), [rest, more])}
        done = {"home": np.full(len(token) - rest, name), "place": owner[here], "shingle": token[here], "freq": np.full(len(token) - rest, MOST_FREQ, np.uint32)}
        return BOTH.rows(plan[0], send, done, {"batch": np.full(len(nodes), name), "spot": np.arange(len(nodes)), "node": nodes, "size": sizes})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for text in texts(batch.column("text")):
                s = shingles(text, hashes, k)
                if len(s) and (node := node_of(s)) not in held:
                    held[node] = s
                    size += len(s)
                if size >= BATCH_SHINGLES:
                    yield settle(held)
                    held, size = {}, 0
                    trim()
        if held:
            yield settle(held)
            trim()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        sent, done, own = BOTH.of(pdf)
        order = np.argsort(sent["token"], kind="stable")
        token, name, at, hot = (sent[x][order] for x in ("token", "from", "at", "hot"))
        if len(token):
            first = starts(token)
            freq = np.where(np.maximum.reduceat(hot, first) > 0, MOST_FREQ, np.add.reduceat((hot == 0).astype(np.int64), first))
            freq = np.repeat(freq, np.diff(np.r_[first, len(token)]))
            keep = (hot == 0) & (freq >= 2)
            back = {"home": name[keep], "place": at[keep], "shingle": token[keep], "freq": freq[keep].astype(np.uint32)}
            done = {x: np.r_[done[x], back[x]] for x in back}
        order = np.lexsort((done["shingle"], done["place"], done["home"]))
        out = BACK.rows(plan[0], {x: a[order] for x, a in done.items()}, own).to_pandas()
        trim()
        return out

    sent = BOTH.deal(df.mapInArrow(scan, BOTH.schema), plan)
    back = BACK.deal(sent.groupBy("frag").applyInPandas(count, BACK.schema), plan)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        got, own = BACK.of(pdf)
        batches = np.unique(own["batch"])

        def number(batch, spot):
            return np.searchsorted(batches, batch).astype(np.int64) << np.int64(32) | spot.astype(np.int64)

        names, at = np.unique(number(own["batch"], own["spot"]), return_index=True)
        nodes, sizes = own["node"][at], own["size"][at]
        whose = np.searchsorted(names, number(got["home"], got["place"]))
        order = np.lexsort((got["shingle"], got["freq"], whose))
        whose, token, freq = whose[order], (got["shingle"][order] >> np.uint64(16)).view(np.int64), got["freq"][order]
        new = np.r_[True, (whose[1:] != whose[:-1]) | (token[1:] != token[:-1])][: len(whose)]  # equal batches have one name
        whose, token, freq = whose[new], token[new], freq[new]
        first = starts(whose)
        ends = np.r_[first[1:], len(whose)][: len(first)]  # none where no set shares a shingle
        out = [_set(int(nodes[whose[a]]), int(sizes[whose[a]]), token[a:b], freq[a:b]) for a, b in zip(first, ends, strict=True) if 100 * int(b - a) >= percent * int(sizes[whose[a]])]
        trim()
        return pd.DataFrame([(*x, freqs) for x, freqs in out], columns=["node", "n", "m", "central", "tokens", *SIGNS, "freqs"])

    def alone(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets of several batches without the shingles that only they hold."""
        for pdf in pdfs:
            out = []
            for row in pdf.itertuples():
                kept = np.asarray(row.freqs, np.int64) > row.copies
                if 100 * int(kept.sum()) >= percent * row.n:
                    out.append(_set(row.node, row.n, np.asarray(row.tokens, np.int64)[kept], np.asarray(row.freqs, np.int64)[kept])[0])
            yield pd.DataFrame(out, columns=["node", "n", "m", "central", "tokens", *SIGNS])

    raw = cut(back.groupBy("frag").applyInPandas(gather, fields + ", freqs array<int>"), "join-raw")
    copies = cut(raw.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "join-copies")
    if copies.isEmpty():
        return raw.drop("freqs")
    several = raw.join(_small(copies), "node").dropDuplicates(["node"]).mapInPandas(alone, fields)
    return raw.join(_small(copies), "node", "left_anti").drop("freqs").unionByName(several)


def _set(node: int, n: int, tokens: np.ndarray, freqs: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The row of a set and the frequencies of its tokens."""
    return (node, n, len(tokens), float(np.log2(freqs).sum()) / n, tokens, *signature(tokens)), freqs.astype(np.int32)


def signature(tokens: np.ndarray) -> list[int]:
    """Parity of the number of tokens in each of 64 * SIGNATURE classes.  Bits
    in which two signatures differ each stand for a token of one set alone."""
    classes = (mix(tokens.view(np.uint64)) % np.uint64(64 * SIGNATURE)).astype(np.int64)
    odd = np.bincount(classes, minlength=64 * SIGNATURE) & 1
    return [int(x) for x in np.packbits(odd.astype(np.uint8)).view(np.int64)]


def _small(side: DataFrame) -> DataFrame:
    """``side`` (a written table) to be broadcast, if it has few rows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _alike(x: str, y: str, percent: int, signs: tuple[str, ...] = SIGNS):
    """The overlap that two signatures leave possible is enough for a link."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in signs])
    return F.col(f"{x}.m") + F.col(f"{y}.m") - differ >= 2 * need(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def need(a, b, percent: int = PERCENT):
    """Least overlap of two sets of sizes ``a`` and ``b`` that links them."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def prefixes(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, node, n, central, pos): the shared shingles within the prefix;
    ``pos`` counts the set's own shingles, which come first in the order."""
    alone = F.col("n") - F.col("m")
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - alone
    return shared.select("node", "n", "central", alone.alias("alone"), F.posexplode(F.slice("tokens", 1, length.cast("int"))).alias("i", "token")).select(
        "token", "node", "n", "central", (F.col("alone") + F.col("i")).alias("pos")
    )


def _possible(x: str, y: str, percent: int):
    """Sizes and, if the shingle is the first in common, positions allow a link."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos")) >= need(nx, ny, percent)


def overlaps(pairs: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, y, nx, ny, overlap) of those pairs (x, y, nx, ny) that can link.

    Each pair is counted in ``VERTICAL`` fragments of the shingle order
    separately; the partial counts are summed per pair.  A fragment whose
    count, with all that the others could hold, stays under the overlap that
    is needed sends nothing: the sum is then too small, as it should be.
    """
    pairs = cut(pairs, "join-pairs")
    n_bucket = max(8, -(-pairs.count() // PAIRS_EACH))
    pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(n_bucket)).cast("int"))
    wanted = pairs.select("bucket", F.col("x").alias("node")).unionByName(pairs.select("bucket", F.col("y").alias("node"))).distinct()
    wanted = _small(cut(wanted, "join-wanted"))
    part = F.explode(F.sequence(F.lit(0), F.lit(VERTICAL - 1)))

    def of(p):
        return F.filter("tokens", lambda t: F.pmod(t, F.lit(VERTICAL)) == p)

    sizes = F.array(*[F.size(of(F.lit(p))) for p in range(VERTICAL)])
    segments = shared.withColumn("sizes", sizes).select("node", "sizes", "tokens", part.alias("part")).select("node", "sizes", "part", of(F.col("part")).alias("tokens"))
    left = wanted.join(segments, "node").select("bucket", "part", "node", "sizes", "tokens")
    right = pairs.select(F.col("bucket").alias("r_bucket"), part.alias("r_part"), "x", "y", "nx", "ny")

    def count(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(pairs):
            return pd.DataFrame(columns=["x", "y", "nx", "ny", "partial"])
        names = nodes["node"].to_numpy(np.int64)
        order = np.argsort(names)
        arrays = [np.sort(nodes["tokens"].iat[i]) for i in order]
        every = np.array([nodes["sizes"].iat[i] for i in order], np.int64)
        names, here = names[order], int(nodes["part"].iat[0])
        sizes = every[:, here]
        bounds = np.r_[0, np.cumsum(sizes)]
        # tokens numbered by value, so that (node, token) is one sorted number
        known, code = np.unique(np.concatenate(arrays), return_inverse=True)
        keys = np.repeat(np.arange(len(names)), sizes) * (len(known) + 1) + code
        x, y = np.searchsorted(names, pairs["x"].to_numpy(np.int64)), np.searchsorted(names, pairs["y"].to_numpy(np.int64))
        partial = np.zeros(len(pairs), np.int64)
        step = max(1, 2_000_000 // max(1, int(sizes.max(initial=1))))
        for at in range(0, len(pairs), step):
            xs, ys = x[at : at + step], y[at : at + step]
            lens = sizes[xs]
            run = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            probe = np.repeat(ys, lens) * (len(known) + 1) + code[np.repeat(bounds[xs], lens) + run]
            where = np.minimum(np.searchsorted(keys, probe), max(0, len(keys) - 1))
            hit = keys[where] == probe if len(keys) else np.zeros(len(probe), bool)
            partial[at : at + step] = np.bincount(np.repeat(np.arange(len(xs)), lens), weights=hit, minlength=len(xs))
        most = np.minimum(every[x], every[y])
        total = pairs["nx"].to_numpy(np.int64) + pairs["ny"].to_numpy(np.int64)
        trim()
        can = (partial + most.sum(1) - most[:, here]) * (100 + percent) >= percent * total
        return pairs[["x", "y", "nx", "ny"]].assign(partial=partial)[can & (partial > 0)]

    parts = left.groupBy("bucket", "part").cogroup(right.groupBy("r_bucket", "r_part")).applyInPandas(count, "x long, y long, nx long, ny long, partial long")
    return parts.groupBy("x", "y", "nx", "ny").agg(F.sum("partial").alias("overlap"))


def _rooted(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """``posts`` with the component (root) that each set has so far."""
    return posts.join(_small(labels), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(here: DataFrame) -> DataFrame:
    """(token, major, n_all, n_minor) of the prefix shingles whose sets are of
    several components: the component most of them are of, how many there are
    and how many are of others."""
    by = here.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    by = by.groupBy("token").agg(F.sum("k").alias("n_all"), F.max(F.struct("k", "root")).alias("top"))
    return cut(by.where("n_all > top.k").select("token", F.col("top.root").alias("major"), "n_all", (F.col("n_all") - F.col("top.k")).alias("n_minor")), "join-mixed")


def _meet(percent: int):
    """Two rows (a, b) of one prefix shingle may be sets of different components that link."""
    return (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", percent)


def _hubs(rows: DataFrame, percent: int, *names: str, part) -> DataFrame:
    """Of each prefix shingle, and part of its sets, the most central set.
    Sets that have the shingle too late for a link with one of their own size
    come after all others."""
    early = F.col("n") - F.col("pos") >= need(F.col("n"), F.col("n"), percent)
    best = F.max_by(F.struct(*names), F.struct(early, "central", "node"))
    rows = rows.withColumn("part", part)
    # written: both sides of the join with them are then plain shuffles, which can be split
    return cut(rows.groupBy("token", "part").agg(best.alias("h")).select("token", "h.*"), "join-hubs")


def links(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root): components of the sets under ``links`` of the threshold.

    Star rounds first, which take a number of pairs linear in the sets, until
    few pairs of different components are left or a round no longer lessens
    them much; then all of those.
    """
    posts = cut(prefixes(shared, percent), "join-posts")
    sketch = shared.select("node", "n", "m", *SIGNS)
    each = SIGNATURE // FOLDED
    folded = [reduce(lambda a, b: a.bitwiseXOR(b), [F.col(SIGNS[i + FOLDED * j]) for j in range(each)]).alias(f) for i, f in enumerate(FEW)]

    def linked(met: DataFrame) -> DataFrame:
        """(a, b): the pairs among those that have met that link."""
        pairs = met.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny")).distinct()
        one = pairs.alias("p").join(sketch.alias("a"), F.col("p.x") == F.col("a.node")).select("p.*", *[F.col(f"a.{k}") for k in ("n", "m", *SIGNS)])
        both = one.alias("a").join(sketch.alias("b"), (F.col("a.y") == F.col("b.node")) & _alike("a", "b", percent))
        done = cut(overlaps(both.select("a.x", "a.y", "a.nx", "a.ny"), shared, percent), "join-overlaps")
        good = F.col("overlap") * 100 >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("overlap"))
        return done.where(good).select(F.col("x").alias("a"), F.col("y").alias("b"))

    def joined(found: DataFrame) -> DataFrame:
        return cut(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)), "join-labels")

    every = posts.withColumn("root", F.col("node"))
    hubs = _hubs(every, percent, "node", "n", "pos", "root", part=F.pmod(F.xxhash64("node"), F.lit(2)))
    labels = cut(components(linked(every.alias("a").join(hubs.alias("b"), _meet(percent)))), "join-labels")
    turn, before = 0, None
    while True:
        here = _rooted(posts, labels)
        mixed = _mixed(here)
        left, rows = mixed.agg(F.sum(F.col("n_all") * F.col("n_minor")), F.sum("n_all")).first()
        if not left:
            return labels
        fields = ("node", "n", "pos", "root", "m", *FEW)
        signed = here.join(mixed.select("token", "major"), "token").join(sketch.select("node", "m", *folded), "node")
        signed = cut(signed.select("token", "major", "central", *fields), "join-signed")
        minor = cut(signed.where("root != major"), "join-minor")
        alike = _meet(percent) & _alike("a", "b", percent, FEW)
        if left > LINEAR * rows and (before is None or left <= before * FALL):
            turn, before = turn + 1, left
            part = F.when(F.col("root") != F.col("major"), -1).otherwise(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HUBS)))
            found = linked(minor.alias("a").join(_hubs(signed, percent, *fields, part=part).alias("b"), alike))
            if not found.isEmpty():
                labels = joined(found)
                continue
        # a pair of different roots has a member outside any one root of its shingle: the largest is left out on one side
        fresh = (F.col("b.root") == F.col("a.major")) | (F.col("a.root") < F.col("b.root"))
        found = linked(minor.alias("a").join(signed.alias("b"), alike & fresh))
        return labels if found.isEmpty() else joined(found)


def similar(df: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", fan: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_node for every row.

    Rows link when their sets of distinct ``k``-word shingles have a Jaccard
    similarity of ``percent`` or more; component_id is the smallest id that
    links reach.  Null, empty or blank texts have no shingles and link with
    nothing, not even each other.  Repeated rows and equal texts are one set;
    a null id takes part and gets the component of the others, or null.
    Very long texts are whole sets.  An empty table gives none.
    """
    return _labelled(df, k, percent, id_col, text_col, fan).drop("root")


def _labelled(df: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", fan: int | None = None) -> DataFrame:
    """As ``similar``, with the root of the component: ids that repeat may give two of them one component_id."""
    spark = df.sparkSession
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = cut(sets(rows, k), "join-docs")
    n_frag = fragments(spark, docs.agg(F.sum("n")).first()[0] or 0, SHINGLES_EACH)
    shared = cut(shared_shingles(rows, n_frag, k, percent, fan), "join-shared")
    labels = links(shared, percent)
    named = docs.where("n > 0").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-groups")
    linked = named.join(groups, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("node").alias("class_node"), "root")
    alone = docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_node"), F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)


def keep_first(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (columns doc_id, text and others) whose id is the
    smallest of the component of their own set.  Rows that repeat an id are
    told apart by their sets: one stays of each component (of different texts
    that with the smallest set and text), and one without shingles.

    Null ids: such rows stay where their component has no other id, and where
    they have no shingles.  Null, empty and very long texts are as in
    ``similar``; an empty table gives none; other columns, whatever their
    names, go along."""
    df, restore = shield(df, "doc_id", "text")
    labelled = cut(_labelled(df).select(F.col("doc_id").alias("first_id"), F.col("class_node").alias("first_node"), "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("own")), "keep-labels")
    own = labelled.where("own").select("first_id", "first_node", "root").distinct()
    ids = cut(labelled.groupBy("first_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("own").alias("own")).where("own").select("first_id", "n_rows"), "keep-ids")
    several = (F.col("n_rows") > 1) | F.col("first_id").isNull()
    once = df.join(_small(ids.where(~several)), F.col("doc_id") == F.col("first_id"), "left_semi")
    if ids.where(several).isEmpty():
        return restore(once)

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        found = [shingles(t, hashes) for t in texts]
        return pd.Series([node_of(x) if len(x) else None for x in found], dtype="Int64")

    names = df.columns
    again = df.join(ids.where(several), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").withColumn("node_", node("text"))
    again = again.join(own, F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("node_").eqNullSafe(F.col("first_node")))
    nameless = again.where(F.col("doc_id").isNull()).select(*names)
    picked = again.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "root").agg(F.min_by(F.struct(*names), F.struct("node_", "text")).alias("row_")).select("row_.*")
    return restore(once.unionByName(picked).unionByName(nameless))
