"""Benchmark decontamination against plain Python on small texts."""

import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("loomgraph.llm")

from loomgraph.llm import decontaminate  # noqa: E402
from tests.llm.helpers import DOCS  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    held = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1) if size else ():
            held.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(x) for x in held}:
            for i in range(len(w) - size + 1):
                if own := held.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= {str(x) for x in own if x is not None}
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def tables(seed=1):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "Lo", "mi", "é", "ßu", "Σα", "9") for b in ("ra", "TU", "ñ", "x1", "ΑΣ", "İ")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 3, 4, 6, 9, 10, 11, 25, 60])))) for i in range(25)]
    items += [(3, "Qa wb ec rd te yf ug ih oi pj ak"), (40, items[20][1]), (41, items[20][1].upper()), (42, items[7][1] + " tail"), (None, "no name at all has this one item of ten words"), (43, None), (44, ""), (45, "--- !"), (46, "zzz"), (46, "zzz")]
    docs = []
    for i in range(150):
        body = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 8, 40, 200]))]
        for _ in range(rng.randint(0, 3)):
            own = words(rng.choice(items)[1])
            a = rng.randrange(len(own) + 1)
            at = rng.randrange(len(body) + 1)
            body[at:at] = own[a // 2 : len(own) - rng.choice([0, 0, 1, 5])]
        docs.append((i % 140, rng.choice([" ", ", ", "'", ".\n"]).join(w.title() if rng.random() < 0.1 else w for w in body), "en", "s", 0))
    docs += [(None, items[20][1], None, None, 0), (500, None, None, None, 0), (501, "", None, None, 0), (502, " ... ", None, None, 0), (503, items[24][1], None, None, 0), (503, items[24][1], None, None, 0), (504, "ΑΣ'Β " * 12, None, None, 0), (505, "zzz", None, None, 0), (506, "no name at all has THIS one item of ten words", None, None, 0)]
    items += [(60, "ΑΣ Β " * 6)]
    return docs, items


def check(spark, docs, items):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name in ("key", "w", "places", "h", "p", "items", "held", "c1"):
        df, bench = df.withColumn(name, F.lit("x")), bench.withColumn(name + "_", F.lit("x")).withColumn(name, F.lit("y"))
    out = decontaminate.contamination(df, bench)
    got = Counter(tuple(r)[:6] for r in out.collect())
    assert got == brute(docs, items)
    return out


def test_decontamination_equals_brute_force(spark):
    docs, items = tables()
    assert sum(n for r, n in brute(docs, items).items() if r[5]) > 50
    out = check(spark, docs, items)
    assert out.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_small_pieces_and_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 3)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    check(spark, *tables(2))


def test_long_texts_and_long_items(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    text = " ".join([f"v{i}" for i in range(20_000)] + long + [f"u{i}" for i in range(5_000)])
    check(spark, [(1, text, None, None, 0), (2, " ".join(long[1500:1600]), None, None, 0)], [(1, " ".join(long)), (2, " ".join(long[1000:1010]))])


def test_decontamination_of_empty_tables(spark):
    docs, items = tables()
    check(spark, docs[:5], [])
    check(spark, docs[:5], [(1, None), (2, " ")])
    check(spark, [], items)
    check(spark, docs[20:21], items)
