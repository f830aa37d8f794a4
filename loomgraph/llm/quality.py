"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-gram models over the same hashed buckets: one of the target
(documents labelled good), one of all raw text.  A document's log importance
weight is the sum over its n-grams of the log ratio of the two; adding Gumbel
noise and keeping the largest keys samples without replacement in proportion
to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHashes, columns, cut, expand, mix, rolling, texts, trim

BUCKETS = 1 << 15
#: Labelled target rows that the target model is fitted on, about: a hash of the id picks that share beyond.
TARGET_ROWS = 20_000
#: Share of the documents that is sampled.
KEEP = 0.5
#: Bins of a range of keys in finding the threshold, and rows of the last bin that are ranked at once.
BINS, RANKED = 4096, 100_000


def grams(text: str, hashes: WordHashes) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text, ASCII case folded."""
    w = hashes.of(text.encode().lower().split())
    return (np.concatenate([mix(w), rolling(w, 2)]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(df: DataFrame) -> np.ndarray:
    """Counts of the buckets over column ``text``, at most BUCKETS rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in texts(batch.column("text")):
                if text:
                    held += np.bincount(grams(text, hashes), minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    got = df.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def log_weights(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight for every row; 0 for texts without words."""
    spark = df.sparkSession
    labels = columns(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    n = good.count()
    share = min(1.0, target_rows / max(1, n))
    good = good.where(F.pmod(F.xxhash64("good_id", F.lit(23)), F.lit(1 << 30)) <= int(share * (1 << 30)))  # at most about target_rows ids
    rows = columns(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    target = _counts(rows.join(F.broadcast(good), F.col("doc_id") == F.col("good_id")).select("text"))
    raw = _counts(rows.select("text"))
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    sent = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), sent.value
        for batch in batches:
            sizes, sums = [], []
            for text in batch.column("text"):
                g = grams(text.as_py(), hashes) if text.is_valid else np.empty(0, np.int64)
                sizes.append(len(g))
                sums.append(float(table[g].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "text_hash", "n_grams", "log_weight"])
            trim()

    return rows.mapInArrow(score, "doc_id long, text_hash long, n_grams long, log_weight double")


RESULT = ["doc_id", "n_grams", "log_weight", "mean_ratio", "key", "selected"]


def resample(df: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Score every row and sample ceil(keep * n) of them by Gumbel top-k.

    Returns doc_id, n_grams, log_weight, mean_ratio (log weight a gram), key
    (log weight plus Gumbel noise) and selected.  The noise is a hash of the
    id, the text, the row's number among rows equal in both, and ``seed``: so
    null ids and ids that repeat draw for each row, and reruns agree.  Ties of
    the key go to the smaller id.  Null or empty texts weigh 0; repeated rows
    are rows of their own; without labels the target model is flat; an empty
    table gives none.
    """
    equal = log_weights(df, labels, id_col, text_col, target_rows).groupBy("doc_id", "text_hash", "n_grams", "log_weight").agg(F.count(F.lit(1)).alias("m"))
    equal = cut(equal, "quality-equal")
    rows = expand(equal, "m", "nr", equal.agg(F.max("m")).first()[0] or 0)
    draw = F.xxhash64("doc_id", "text_hash", "nr", F.col("doc_id").isNull(), F.lit(seed))
    u = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)
    mean = F.coalesce(F.col("log_weight") / F.nullif(F.col("n_grams"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("mean_ratio", mean).withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    rows = cut(rows.select("doc_id", "n_grams", "log_weight", "mean_ratio", "key"), "quality")
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    need = int(-(-n * keep // 1))
    if not need:
        return rows.withColumn("selected", F.lit(False)).select(*RESULT)
    low, high, left, n = _edge(rows, low, high, need, n)
    between = F.col("key").between(low, high)
    out = rows.where(~between).withColumn("selected", F.col("key") > high)
    # equal rows are one here, so that a key that repeats without end is one row to rank
    same = [c for c in RESULT if c != "selected"]
    equal = rows.where(between).groupBy(*same).agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last(), "log_weight", "n_grams").rowsBetween(Window.unboundedPreceding, -1)
    equal = cut(equal.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))), "quality-edge")
    most = equal.agg(F.max("c")).first()[0] or 0
    at = expand(equal, "c", "nr", most).withColumn("selected", F.col("before") + F.col("nr") < left)
    return out.select(*RESULT).unionByName(at.select(*RESULT))


def _edge(rows: DataFrame, low: float, high: float, left: int, n: int) -> tuple[float, float, int, int]:
    """A range of keys that holds the last key to select, how many of its rows
    are selected, and how many there are: few or all equal.  Each turn counts
    the rows in equal bins of the range and goes on with one of them."""
    while n > RANKED and low < high:
        bin_ = F.least(F.floor((F.col("key") - low) / (high - low) * BINS), F.lit(BINS - 1))
        here = rows.where(F.col("key").between(low, high)).groupBy(bin_.alias("bin"))
        for r in here.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect():
            if r["n"] >= left:
                low, high, n = r["low"], r["high"], r["n"]
                break
            left -= r["n"]
    return low, high, left, n
