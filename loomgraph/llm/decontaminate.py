"""Benchmark decontamination by a prefix-filtered set join on word shingles.

DataFrame functions only.  A benchmark item is cut into pieces of at most
``PIECE`` windows.  A window holds shingles of up to five words, and a document
holds the window only if it holds all of these, so one necessary shingle for
each window, the rarest in the corpus, is enough to find candidates.

* The first pass over the documents probes every shingle of theirs against the
  set of benchmark shingles; only the places of hits (numbers) are written, and
  counted for the order by rarity.
* Hits join the necessary shingles.  A hit fixes where the piece would lie in
  the document; bounds on length and position drop what cannot hold a window.
* The second pass compares each candidate place with the piece's words, window
  by window, exactly, and counts words and items.

Shingles are hashed over upper-cased words, which takes in all texts that are
equal after folding A-Z alone, and more; the exact comparison folds A-Z alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut

#: Words of a window and of a shingle (fewer in shorter items).
WINDOW, SHINGLE = 10, 5
#: Windows of one piece of an item.
PIECE = 64
#: What parts words: ASCII but for digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark shingles (16 bytes each) up to which they are broadcast, and bytes of candidates; beyond, both sides are shuffled.
BROADCAST_SHINGLES, BROADCAST_BYTES = 1_000_000, 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _once(df: DataFrame, **named: Column) -> DataFrame:
    """``df`` with further columns behind a generator: what uses them in a
    lambda or several times finds values, not expressions to evaluate again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))


def _shingle(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def pieces(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(piece, n_window, k, words, items): pieces of items (item, text) that
    differ in their words, with the ids of the items that hold them."""
    whole = _once(items.where(F.col("text").isNotNull()), w=words(folded(F.col("text")))).withColumn("n_window", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("n_window"), F.lit(PIECE))
    cut_up = whole.where("n_window > 0").select("item", "w", "n_window", F.explode(starts).alias("start"))
    own = F.slice("w", F.col("start") + 1, F.col("n_window") + PIECE - 1)
    found = cut_up.groupBy(own.alias("words"), "n_window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.select(F.xxhash64("words", "n_window").alias("piece"), "n_window", F.least("n_window", F.lit(shingle)).alias("k"), "words", "items")


def shingles(parts: DataFrame, ks: list[int]) -> DataFrame:
    """(piece, n_window, k, n_piece, at, h): every shingle of every piece."""
    upper = _once(parts.select("piece", "n_window", "k", F.size("words").alias("n_piece"), "words"), u=F.transform("words", lambda w: F.upper(w)))
    at = upper.select("piece", "n_window", "k", "n_piece", "u", F.explode(F.sequence(F.lit(0), F.col("n_piece") - F.col("k"))).alias("at"))
    h = F.coalesce(*[F.when(F.col("k") == k, _shingle("u", F.col("at"), k)) for k in ks])
    return at.select("piece", "n_window", "k", "n_piece", "at", h.alias("h"))


def hits(docs: DataFrame, wanted: DataFrame, ks: list[int]) -> DataFrame:
    """(key, n, p, h): places p of documents (key, text) of n words where a wanted shingle starts."""
    # an outer generator: for an inner one the optimizer would split each text two times more to filter
    w = docs.select("key", words(F.upper("text")).alias("w"))
    at = w.select("key", "w", F.posexplode_outer("w").alias("p", "word")).withColumn("n", F.size("w"))
    probes = [_shingle("w", F.col("p"), k) for k in ks]
    at = at.select("key", "n", "p", probes[0].alias("h") if len(ks) == 1 else F.explode_outer(F.array(*probes)).alias("h"))
    return at.join(wanted, "h", "left_semi")


def necessary(grams: DataFrame, found: DataFrame) -> DataFrame:
    """(h, piece, at, n_window, first, last): for each window its rarest
    shingle, with the first and last window start that it stands for."""
    rarity = found.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    known = grams.join(rarity, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("at") - (F.col("n_window") - F.col("k")))
    last = F.least(F.col("at"), F.col("n_piece") - F.col("n_window"))
    windows = known.withColumn("start", F.explode(F.sequence(first, last)))
    rarest = windows.groupBy("piece", "n_window", "start").agg(F.min(F.struct("df", "h", "at")).alias("r"))
    return rarest.where("r.df > 0").groupBy("r.h", "piece", "r.at", "n_window").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def candidates(found: DataFrame, prefix: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, places): where in a document which piece may lie; places of
    (begin of the piece, n_window, words, items)."""
    begin = F.col("p") - F.col("at")
    fits = (begin + F.col("last") >= 0) & (begin + F.col("first") + F.col("n_window") <= F.col("n"))
    met = found.join(prefix, "h").where(fits).select("key", "piece", begin.alias("begin")).distinct()
    place = F.struct("begin", "n_window", "words", "items")
    return met.join(parts, "piece").groupBy("key").agg(F.collect_list(place).alias("places"))


def _few(side: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(side) if few else side


def contamination(df: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z
    folded.  A window is ``window`` consecutive words of an item, or the whole
    item if it has fewer; a word inside any occurrence of a window is hit, and
    n_items counts the items whose windows occur.  items_sha256 digests their
    ids, as sorted strings joined by commas (of none: of the empty string).

    Null texts and texts without words have no windows and no hits.  Ids that
    repeat, null ids and equal texts are rows of their own; items that repeat an
    id are one item with the windows of all; an item with a null id has windows
    that hit, but no name to count.  Very long texts and items are whole.  Other
    columns do not matter.  Without items nothing is hit; an empty table gives
    no rows.
    """
    spark = df.sparkSession
    rows = columns(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = columns(items, item=item_col, text="text").select(F.col("item").cast("string").alias("item"), "text")
    parts = cut(pieces(named, window, shingle), "decontaminate-pieces")
    ks = sorted(r["k"] for r in parts.select("k").distinct().collect())  # at most ``shingle`` numbers
    if ks:
        grams = cut(shingles(parts, ks), "decontaminate-shingles")
        wanted = cut(grams.select("h").distinct(), "decontaminate-wanted")
        few = wanted.count() <= BROADCAST_SHINGLES
        found = cut(hits(rows.select("key", "text"), _few(wanted, few), ks), "decontaminate-hits")
        prefix = cut(necessary(grams, found), "decontaminate-prefix")
        few = prefix.count() <= BROADCAST_SHINGLES // 4
        places = cut(candidates(found, _few(prefix, few), parts), "decontaminate-candidates")
    else:
        place = "struct<begin:int,n_window:int,words:array<string>,items:array<string>>"
        places = spark.createDataFrame([], f"key long, places array<{place}>")
    return _verified(rows, places)


def _verified(rows: DataFrame, places: DataFrame) -> DataFrame:
    width = F.aggregate("places", F.lit(24).cast("long"), lambda n, c: n + 64 + 24 * (F.size(c["words"]) + F.size(c["items"])))
    few = (places.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES
    both = rows.join(_few(places, few), "key", "left")
    suspect = F.col("places").isNotNull()
    docs = _once(both.select("doc_id", "text", "places"), w=words(F.when(suspect, folded(F.col("text"))).otherwise(F.col("text"))))

    def starts(c: Column) -> Column:
        """Document places at which a window of the candidate lies."""
        last = F.size(c["words"]) - c["n_window"]
        here = F.sequence(F.greatest(F.lit(0), -c["begin"]), last)
        inside = F.filter(here, lambda o: F.slice("w", c["begin"] + o + 1, c["n_window"]) == F.slice(c["words"], o + 1, c["n_window"]))
        return F.when(last >= -c["begin"], F.transform(inside, lambda o: c["begin"] + o)).otherwise(F.array().cast("array<int>"))

    held = F.transform("places", lambda c: F.struct(starts(c).alias("at"), c["n_window"].alias("n_window"), c["items"].alias("items")))
    docs = _once(docs, all_held=F.when(suspect, held))
    docs = docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.filter("all_held", lambda c: F.size(c["at"]) > 0).alias("held"))
    covered = F.flatten(F.transform("held", lambda c: F.flatten(F.transform(c["at"], lambda s: F.sequence(s, s + c["n_window"] - 1)))))
    n_hit = F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")
    ids = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("held", lambda c: c["items"])))), F.array().cast("array<string>"))
    docs = docs.select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("items"))
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
