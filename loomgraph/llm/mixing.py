"""Mixing sources to target weights by pivotal dependent rounding.

DataFrame functions only.  Every document of a source is wanted
``target / source size`` times.  The whole part of that number is taken for
certain; the fraction is rounded by pivotal steps: two documents meet, words
of probability mass move from one to the other (direction by chance, so that
expectations stay), until one of them is wholly in or wholly out.  The other
meets the next.  A step keeps the sum of the two in words, so a source's sum
is kept exactly.

Steps run in a reduction tree: documents are dealt into blocks of about
``FANOUT``, each block leaves one residual document, blocks of residuals
leave one again, until each source has one.  Rows of one id, source and text
are one item of the tree: with m of them, the whole part of m times the
fraction is taken for certain, and one of them goes on with what is left.  So
no group grows with the input, and a source that holds a third of all rows is
just more blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut, expand, running, shield

#: Words are runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No document and no source is taken more often than this.
MOST = 3.0
#: Documents, and then residuals, of one block of the tree.
FANOUT = 128
#: Sources beyond which their table is no longer broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000
#: Items of several rows beyond which they are no longer broadcast (about 100 bytes each).
BROADCAST_ITEMS = 100_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, sid, target) from rows (source, size).

    Sources in the order of their code points, null last, weigh ``weights``,
    repeating.  Targets share the sum of all sizes by weight and stop at
    ``most`` times the source's size; what is over is shared again by weight
    among the rest.  That is min(most * size, level * weight) for one level,
    found by sorting sources by the level at which they are full.
    """
    by = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-by-source")
    ranked = running(by, [F.col("source").asc_nulls_last()], "mix-ranked").withColumnRenamed("before", "sid")
    picks = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.get(picks, F.pmod("sid", F.lit(len(weights)))))
    ranked = ranked.withColumn("full", F.lit(most) * F.col("source_size") / F.col("w"))
    # by the level at which they are full: what the sources before take, and the weights from here on
    ranked = running(ranked, [F.col("full"), F.col("sid")], "mix-full", taken=F.lit(most) * F.col("source_size"), lighter=F.col("w"))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    ranked = ranked.withColumn("level", (F.lit(total).cast("double") - F.col("taken")) / (F.lit(weight) - F.col("lighter")))
    at = ranked.agg(F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "sid", "level"))).alias("at")).first()
    ranked = ranked.withColumn("at", F.lit(at and at["at"] and at["at"]["level"]).cast("double"))
    return ranked.select("source", "source_size", "n", "sid", F.least(F.lit(most) * F.col("source_size"), F.col("at") * F.col("w")).alias("target"))


def _chance(*keys) -> Column:
    """Uniform in [0, 1), from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") / float(1 << 52)


def _step(acc: Column, x: Column) -> Column:
    """One pivotal step of the held document and the next one."""
    held = acc["held"]
    a, b = held["size"].cast("double"), x["size"].cast("double")
    u, v = held["p"] * a, x["p"] * b
    to_held, to_next = F.least(a - u, v), F.least(u, b - v)
    gains = x["r"] * (to_held + to_next) < to_next  # held gains with probability to_next / (both)
    held_out = F.when(gains, a - u <= v).otherwise(u <= b - v)  # is held the one that becomes whole?

    def done(d: Column, copies: Column) -> Column:
        return F.struct(d["id"].alias("id"), d["size"].alias("size"), copies.cast("int").alias("up"), F.lit(0).cast("long").alias("words"))

    def left(d: Column, p: Column) -> Column:
        return F.struct(d["id"].alias("id"), d["size"].alias("size"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), d["r"].alias("r"))

    up_held, up_next = F.when(gains, 1).otherwise(0), F.when(gains, 0).otherwise(1)
    whole = F.when(held_out, done(held, up_held)).otherwise(done(x, up_next))
    rest = F.when(held_out, left(x, F.when(gains, v - (a - u)).otherwise(v + u) / b)).otherwise(left(held, F.when(gains, u + v).otherwise(u - (b - v)) / a))
    first = acc["held"].isNull()
    return F.struct(
        F.when(first, left(x, x["p"])).otherwise(rest).alias("held"),
        F.when(first, acc["done"]).otherwise(F.concat(acc["done"], F.array(whole))).alias("done"),
    )


DOC = "struct<id:bigint,size:bigint,p:double,r:double>"
DONE = "array<struct<id:bigint,size:bigint,up:int,words:bigint>>"
SOURCE = ("sid",)


def plan(rows: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 1) -> tuple[DataFrame, int]:
    """How often to take the rows of each item (doc_id, source, text_hash,
    size): m rows, of which ``ups`` are taken base + 1 times and the others
    base times, and ``words`` words more of one that is not among the ups.
    With it the largest m.

    Items are known in the tree by a hash of all four columns: those that
    share it by chance share its rounding, which gives up as many copies.
    """
    items = rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("m"))
    items = cut(items, "mix-items")
    largest = items.agg(F.max("m")).first()[0] or 0
    targets = cut(source_targets(items.select("source", (F.col("size") * F.col("m")).alias("size")), weights, most), "mix-sources")
    facts = targets.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    side = F.broadcast(targets) if facts["n"] <= BROADCAST_SOURCES else targets
    items = items.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.n", "t.sid", "t.source_size", "t.target")
    share = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    near = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    items = items.withColumn("base", F.floor(near).cast("int")).withColumn("p", near - F.floor(near))
    whole = F.floor(F.col("m") * F.col("p") + 1e-9)
    rest = F.greatest(F.col("m") * F.col("p") - whole, F.lit(0.0))
    items = items.withColumn("sure", F.when(F.col("size") > 0, whole).otherwise(0).cast("long")).withColumn("p", F.when((F.col("size") > 0) & (rest > 1e-9), rest).otherwise(0.0))
    items = items.withColumn("base", F.when(F.col("size") > 0, F.col("base")).otherwise(0)).withColumn("id", F.xxhash64("doc_id", "source", "text_hash", "size", F.lit(seed)))

    blocks = -(-int(facts["most"] or 1) // FANOUT)
    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / FANOUT))
    item = F.struct("id", "size", "p", _chance("id", F.lit(seed + 1)).alias("r"))
    tree = items.where("p > 0").select(*SOURCE, block.alias("block"), item.alias("item"))
    level, settled = 0, None
    while True:
        grouped = tree.groupBy(*SOURCE, "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        # the documents meet in an order by chance, not by id
        mixed = F.array_sort(F.transform("items", lambda x: F.struct(F.xxhash64(x["id"], F.lit(seed + 7 * level)).alias("k"), x.alias("x"))))
        state = F.aggregate(F.transform(mixed, lambda y: y["x"]), F.struct(F.lit(None).cast(DOC).alias("held"), F.array().cast(DONE).alias("done")), _step)
        solved = cut(grouped.select(*SOURCE, "block", state.alias("s")), f"mix-level{level}")
        done = solved.select(F.explode("s.done").alias("d")).select("d.id", "d.up", F.lit(0).cast("long").alias("words"))
        settled = done if settled is None else settled.unionByName(done)
        if blocks <= 1:
            break
        level += 1
        blocks = -(-blocks // FANOUT)
        again = F.struct(F.col("s.held.id").alias("id"), F.col("s.held.size").alias("size"), F.col("s.held.p").alias("p"), _chance("s.held.id", F.lit(seed + 1 + level)).alias("r"))
        tree = solved.select(*SOURCE, F.floor(F.col("block") / FANOUT).alias("block"), again.alias("item"))
    words = F.round(F.col("s.held.p") * F.col("s.held.size")).cast("long")
    ends = words == F.col("s.held.size")  # a remaining copy that is whole is one copy more
    last = solved.where(F.col("s.held").isNotNull()).select(F.col("s.held.id").alias("id"), F.when(ends, 1).otherwise(0).alias("up"), F.when(ends, 0).otherwise(words).cast("long").alias("words"))
    settled = settled.unionByName(last).groupBy("id").agg(F.max("up").alias("up"), F.max("words").alias("words"))
    out = items.join(settled, "id", "left")
    own = F.col("p") > 0
    ups = F.col("sure") + F.when(own, F.coalesce("up", F.lit(0))).otherwise(0)
    return out.select("doc_id", "source", "text_hash", "size", "m", "source_size", "target", "base", ups.alias("ups"), F.when(own, F.coalesce("words", F.lit(0))).otherwise(0).cast("long").alias("words")), largest


def _items(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, text_hash, size) of every row."""
    return columns(df, doc_id=id_col, source=source_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _text_hash("text"), _size("text")
    )


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def mix(df: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often to take each row so that sources come to their targets.

    Returns doc_id, size (words; null text: 0), source_size, target (of the
    row's source), copies (whole copies), words (of one further copy that
    ends early: one row a source at most, so that the source's sum of words
    is its target to within one) and taken = copies * size + words.

    Rows without words are taken 0 times.  Null ids, repeated rows and other
    columns are fine: each row counts.  Very long texts are more words.
    Chance comes from a hash of the id, source, text and ``seed``, so reruns
    agree.  An empty table gives none.
    """
    every, largest = plan(_items(df, id_col, text_col, source_col), weights, most, seed)
    rows = expand(every, "m", "nr", largest)
    copies = F.col("base") + F.when(F.col("nr") < F.col("ups"), 1).otherwise(0)
    words = F.when(F.col("nr") == F.col("ups"), F.col("words")).otherwise(0).cast("long")
    rows = rows.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), words.alias("words"))
    return rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("words"))


def apply_mix(df: DataFrame, seed: int = 1) -> DataFrame:
    """The mixed rows themselves: each row of ``df`` as often as ``mix`` says,
    a copy that ends early counting as one if it holds half the words or more.
    Rows without words carry none and stay as they are.  Null ids, repeated
    rows and very long texts are as in ``mix``; an empty table gives none.
    Same columns as ``df``, whatever the others are called.
    """
    df, restore = shield(df, "doc_id", "text", "source")
    names = df.columns
    keys = [F.col("doc_id").cast("long").alias("mix_id"), F.col("source").cast("string").alias("mix_source"), _text_hash("text").alias("mix_hash")]
    every, largest = plan(_items(df, "doc_id", "text", "source"), seed=seed)
    every = every.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_hash").alias("p_hash"), F.col("size").alias("p_size"), "m", "base", "ups", "words")
    on = F.col("mix_id").eqNullSafe(F.col("p_id")) & F.col("mix_source").eqNullSafe(F.col("p_source")) & (F.col("mix_hash") == F.col("p_hash"))
    # of the words of a copy that ends early, half or more make a copy
    every = every.withColumn("ups", F.col("ups") + F.when((F.col("words") > 0) & (F.col("words") * 2 >= F.col("p_size")), 1).otherwise(0))
    keyed = df.select(*names, *keys)
    out = keyed.join(every.where("m = 1"), on).select(*names, F.when(F.col("p_size") == 0, 1).otherwise(F.col("base") + F.col("ups")).cast("long").alias("mix_times"))
    if largest > 1:
        # the texts of the other rows are shuffled again only where such items are many
        repeated = cut(every.where("m > 1"), "mix-repeated")
        joined = keyed.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ITEMS else repeated, on)
        out = out.unionByName(_in_turn(joined, names))
    return restore(expand(out, "mix_times", "mix_copy", largest * int(MOST + 1)))


def _in_turn(joined: DataFrame, names: list[str]) -> DataFrame:
    """Rows of one id, source and text with how often to take each: equal ones
    are put together first, then they take the ups in turn."""
    group = ("mix_id", "mix_source", "mix_hash")
    equal = joined.groupBy(*group, F.xxhash64(*names).alias("mix_row")).agg(F.first(F.struct(*names)).alias("row"), F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("p_size", "base", "ups")])
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy("mix_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("ups") - before, F.lit(0)), F.col("c"))
    times = F.when(F.col("p_size") == 0, F.col("c")).otherwise(F.col("c") * F.col("base") + more).cast("long")
    return equal.withColumn("mix_times", times).select("row.*", "mix_times")
