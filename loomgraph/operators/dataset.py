"""Training examples from triples, and their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import extract

INSTRUCTION = "Extract knowledge triples from the text."


def paragraphs(docs: DataFrame, least: int = 100, most: int | None = None) -> DataFrame:
    """(doc_id, pos, paragraph): blocks between blank lines longer than ``least``, the first ``most`` of a document."""
    # a lambda: given F.trim itself, transform hands it the position as the characters to trim
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"\A\p{Zs}+|\p{Zs}+\z", "")), lambda p: F.length(p) > least)
    return docs.select("doc_id", F.posexplode(parts if most is None else F.slice(parts, 1, most)).alias("pos", "paragraph"))


def word_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk): word windows of a document."""
    return docs.select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("pos", "chunk"))


def examples(chunk_rows: DataFrame, source: str, least: int = 2) -> DataFrame:
    """(doc_id, chunk_index, input, output, source): chunks with ``least``
    triples or more, the triples joined by line ends."""
    raw = extract.computed(chunk_rows, raw=extract.pattern_matches(F.col("chunk"))).where(F.size("raw") >= least)
    kept = extract.refined(raw).withColumnRenamed("kept", "t").where(F.size("t") >= least)
    lines = F.transform("t", lambda x: T.format_triple(x["subject"], x["relation"], x["object"]))
    return kept.select("doc_id", "chunk_index", F.col("chunk").alias("input"), F.array_join(lines, "\n").alias("output"), F.lit(source).alias("source"))


def manual(annotations: DataFrame) -> DataFrame:
    """Examples from (text, triples, metadata): marked manual, own metadata wins."""
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    plain = F.map_concat(F.map_filter(F.create_map(F.lit("source"), F.lit("manual")), lambda k, v: ~F.map_contains_key(own, k)), own)
    return annotations.select(F.col("text").alias("input"), F.array_join("triples", "\n").alias("output"), plain.alias("metadata"))


#: Own templates: text, and the triples that it states.
TEMPLATES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("{a} is a kind of {b}. {a} is used for {c}.", ("S:{a}|R:IS_A|O:{b}", "S:{a}|R:USED_FOR|O:{c}")),
    ("{a} contains {b}, and {b} leads to {c}.", ("S:{a}|R:HAS_PART|O:{b}", "S:{b}|R:LEADS_TO|O:{c}")),
    ("{a} causes {b}. {b} comes before {c}. {a} is similar to {c}.", ("S:{a}|R:CAUSES|O:{b}", "S:{b}|R:BEFORE|O:{c}", "S:{a}|R:SIMILAR_TO|O:{c}")),
    ("{a} has {b}. {c} is a type of {a}.", ("S:{a}|R:HAS_PROPERTY|O:{b}", "S:{c}|R:IS_A|O:{a}")),
)
VOCABULARY = ("graph", "tree", "list", "index", "query", "schema", "table", "vector", "matrix", "kernel", "parser", "lexer", "cache", "queue", "stack", "thread")


def synthetic(spark, n: int, seed: int = 1) -> DataFrame:
    """``n`` examples from templates; choices come from a hash of the row number and ``seed``."""
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    texts = F.array(*[F.lit(t) for t, _ in TEMPLATES])
    outs = F.array(*[F.lit("\n".join(o)) for _, o in TEMPLATES])
    pick = lambda k, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(size)).cast("int")
    rows = spark.range(n)
    # three different words: steps of 1 to 5 from the first
    first = pick(1, len(VOCABULARY))
    second, third = (first + 1 + pick(2, 5)) % len(VOCABULARY), (first + 6 + pick(3, 5)) % len(VOCABULARY)
    which = pick(0, len(TEMPLATES))

    def fill(t: Column) -> Column:
        for slot, i in (("{a}", first), ("{b}", second), ("{c}", third)):
            t = F.replace(t, F.lit(slot), F.get(words, i))
        return t

    return rows.select("id", fill(F.get(texts, which)).alias("input"), fill(F.get(outs, which)).alias("output"), F.lit("synthetic").alias("source"))


def instruction_form(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(INSTRUCTION).alias("instruction"), "input", "output")


def prompts(rows: DataFrame) -> DataFrame:
    """Training text: prompt followed by the output."""
    return rows.select(F.concat(T.prompt(F.lit(INSTRUCTION), F.col("input")), "output").alias("text"))


def split(rows: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 1) -> DataFrame:
    """``rows`` with ``split``: exactly int(train * n) train, int(val * n) val,
    the rest test, in the order of a hash of the key.

    The cut points are found from counts of hash bins; only the bins that hold
    them are ranked.
    """
    n = rows.count()
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    bins = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    keyed = rows.withColumn("_h", h).withColumn("_bin", bins)
    counts = {r["_bin"]: r["n"] for r in keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4096
    offsets, total = [], 0
    for b in range(4096):
        offsets.append(total)
        total += counts.get(b, 0)
    table = F.array(*[F.lit(x) for x in offsets])
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", key)) - 1 + F.get(table, F.col("_bin"))
    a, b = int(train * n), int(train * n) + int(val * n)
    return keyed.withColumn("split", F.when(place < a, "train").when(place < b, "val").otherwise("test")).drop("_h", "_bin")


def count_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
