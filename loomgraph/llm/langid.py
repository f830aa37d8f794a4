"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) pairs natively summed from batches; the
matrix of log probabilities (languages x buckets) is broadcast in blocks of
languages; documents are scored sparsely in numpy, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import columns, cut, shield, texts, trim

#: Lengths of the character n-grams.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Labelled rows that the model is fitted on, about: beyond, a hash of the id picks that share of each language, or
#: LANGUAGE_ROWS of it where the share is less.
TRAIN_ROWS = 60_000
#: Labelled rows up to which a language is learned from all of them, about.
LANGUAGE_ROWS = 1_000
#: Languages of one block of the model; there are as many blocks as it takes.
LANGUAGES = 256
#: Counts of texts held at a time while the blocks of the model change.
HELD = 2_000_000
#: Characters of a text handled at a time.
SLICE = 2_000_000
LETTER = regex.compile(r"\p{L}")
UND = "und"


def counts(text: str) -> np.ndarray:
    """How many n-grams of a whole text, in lower case and between two line
    ends, are in each bucket; a very long text is gone through in pieces that
    overlap, so that no n-gram is lost."""
    whole, out = f"\n{text.lower()}\n", np.zeros(BUCKETS, np.int64)
    for at in range(0, len(whole), SLICE):
        codes = np.frombuffer(whole[at : at + SLICE + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            m = min(SLICE, len(codes) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, 0x811C9DC5 + n, np.uint32)
            for j in range(n):
                h = (h ^ codes[j : m + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Iterator[tuple[list[str], np.ndarray]]:
    """(languages, log probabilities: languages x (buckets + 1), the last the
    prior) of every language that is not held out."""
    known = columns(df, doc_id=id_col, text=text_col, lang=label_col).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    langs = sorted(sizes)
    if not langs:
        return
    share = min(1.0, train_rows / total)

    def picked(shares: dict[int, float]) -> DataFrame:
        """(i, text): of each language (its number) about that share of its rows."""
        bounds = df.sparkSession.createDataFrame([(langs[i], i, int(x * (1 << 30)) + 1) for i, x in shares.items()], T.StructType([T.StructField("lang", known.schema["lang"].dataType), T.StructField("i", T.IntegerType()), T.StructField("bound", T.LongType())]))
        return known.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("bound")).select("i", "text")

    def pairs(held: dict[int, np.ndarray]) -> pd.DataFrame:
        found = [(i, np.flatnonzero(n)) for i, n in held.items()]
        i = np.repeat(np.array([i for i, _ in found], np.int32), [len(b) for _, b in found])
        b = np.concatenate([b for _, b in found]) if found else np.empty(0, np.int64)
        n = np.concatenate([held[i][b] for i, b in found]) if found else np.empty(0, np.int64)
        return pd.DataFrame({"i": i, "bucket": b.astype(np.int32), "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, text in zip(pdf["i"], pdf["text"], strict=True):
                if i not in held:
                    if len(held) == LANGUAGES:
                        yield pairs(held)
                        held = {}
                    held[i] = np.zeros(BUCKETS, np.int64)
                held[i] += counts(text)
            trim()
        yield pairs(held)

    def counted(shares: dict[int, float]) -> DataFrame:
        return picked(shares).mapInPandas(count, "i int, bucket int, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n"))

    got = counted({i: min(1.0, max(share, LANGUAGE_ROWS / sizes[x])) for i, x in enumerate(langs)})
    if len(langs) > LANGUAGES:
        got = cut(got, "langid")
        seen = {r["i"] for r in got.select("i").distinct().collect()}
    else:
        got = got.toPandas()
        seen = set(got["i"])
    # rows of one id are picked together, or none of them
    missed = [i for i in range(len(langs)) if i not in seen]
    if missed:
        more = counted(dict.fromkeys(missed, 1.0))
        got = pd.concat([got, more.toPandas()]) if len(langs) <= LANGUAGES else got.unionByName(cut(more, "langid"))
    for first in range(0, len(langs), LANGUAGES):
        names = langs[first : first + LANGUAGES]
        here = got if len(langs) <= LANGUAGES else got.where(F.col("i").between(first, first + len(names) - 1)).toPandas()
        found = np.full((len(names), BUCKETS), 0.5)
        found[here["i"].to_numpy() - first, here["bucket"].to_numpy()] += here["n"].to_numpy()
        logs = np.log(found) - np.log(found.sum(1, keepdims=True))
        prior = np.array([sizes[x] for x in names], float)
        yield names, np.c_[logs, np.log(prior / total)].astype(np.float32)


def _loaded(sent: Broadcast, keep: bool) -> tuple[list[str], np.ndarray]:
    """A block of the model.  Unless to ``keep``, it is read anew from the
    broadcast's file, so that a worker holds one block at a time."""
    return sent.value if keep or sent._path is None else sent.load_from_path(sent._path)


def predict(rows: DataFrame, model: Iterable[tuple[list[str], np.ndarray]]) -> DataFrame:
    """``rows`` (column text_ and others) with lang_pred and score (posterior
    probability) instead of the text.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned.  Ties go to the language that sorts first.  The blocks of the
    model are gone through in turn, with the best and the mass of each text
    carried along.
    """
    sent = [rows.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T))) for langs, logs in model]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in in batches:
            preds, top, mass = [UND] * len(rows_in), np.full(len(rows_in), -np.inf), np.zeros(len(rows_in))

            def settle(held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
                for block in sent:
                    names, table = _loaded(block, len(sent) == 1)
                    for row, seen, n in held:
                        sums = table[BUCKETS].astype(np.float64) + n @ table[seen].astype(np.float64)
                        best = int(np.argmax(sums))
                        if sums[best] > top[row]:
                            mass[row] *= np.exp(top[row] - sums[best])
                            top[row], preds[row] = sums[best], names[best]
                        mass[row] += np.exp(sums - top[row]).sum()

            held, entries = [], 0
            for row, text in enumerate(texts(rows_in.column("text_"))):
                if text is None or not sent or not LETTER.search(text):
                    continue
                n = counts(text)
                seen = np.flatnonzero(n)
                held.append((row, seen, n[seen]))
                entries += len(seen)
                if len(sent) == 1 or entries > HELD:
                    settle(held)
                    held, entries = [], 0
            settle(held)
            scores = np.divide(1.0, mass, out=np.zeros(len(mass)), where=mass > 0)
            kept = [n for n in rows_in.schema.names if n != "text_"]
            arrays = [rows_in.column(n) for n in kept] + [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "lang_pred", "score"])
            trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text_")
    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the rows that are not held out, predict every row.

    Returns doc_id, held_out, lang_pred, score.  A prediction uses the text
    alone.  Null ids are never held out; repeated rows are each predicted;
    very long texts are counted whole; an empty table gives none.
    """
    model = train(df, id_col, text_col, label_col, train_rows)
    rows = columns(df, doc_id=id_col, text_=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text_")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` (same columns) whose language is found: those without
    text or letters, or with a posterior under ``least``, go.

    Null ids and languages, repeated rows and very long texts are as in
    ``identify``: rows are judged each by its own text.  An empty table, and
    one without a language to learn from, gives none; other columns, whatever
    their names, go along."""
    model = train(df)
    inner, restore = shield(df, "text")
    out = predict(inner.withColumn("text_", F.col("text")), model)
    return restore(out.where((F.col("lang_pred") != UND) & (F.col("score") >= least)))
