"""Exact removal of repeated word windows, by fixed-block anchors.

Any run of 20 words holds a whole aligned block of 10 words of its document,
so two equal runs always show as a block of one that a rolling window of 10
words of the other hits, for either of the two.  First, blocks of all
documents are indexed and probed with every rolling window of all documents,
by hash fragment; blocks that a second place shares are returned to their
documents as anchors.  Second, hits are extended: only runs of 20 words around
an anchor can repeat, and only their hashes are compared, by fragment, for the
earliest place of each.  Runs that have an earlier equal are returned to their
document as positions; overlapping runs join to maximal repeats, whose words
go.

A document is known by its key, a hash of id and text: rows that repeat an id
with another text are documents of their own.  What a batch of documents can
tell by itself (a block or run that it holds twice) goes straight back, so a
fragment gets a very common block or run once from each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import MULT, MULT2, Packed, WordHashes, columns, cut, fragments, rolling, shield, squeeze_sorted, stages, starts, texts, trim, unsqueeze_sorted

WINDOW = 20
#: Bytes of text for one fragment, about, and words that a task gathers at a time.
BYTES_EACH = 6_000_000
BATCH_WORDS = 400_000
#: Bytes of the positions to cut up to which they are broadcast to the texts; beyond, both are shuffled by document.
BROADCAST_BYTES = 32 << 20
#: Rows that go back to documents: their key and id, and places in them.
BACK = Packed({"key": np.uint64, "doc": np.int64, "place": np.uint32})
#: Rolling windows of a batch (flags: 1 seen twice, 2 a block), blocks to tell of, and blocks that have been hit.
PROBES = Packed({"probe": np.uint64, "flags": np.uint8}, {"block": np.uint64, "owner": np.uint64, "at": np.uint32}, {"key": np.uint64, "doc": np.int64, "place": np.uint32})
#: First runs of a batch with their places, and runs that have an earlier equal.
RUNS = Packed({"run": np.uint64, "run_key": np.uint64, "run_doc": np.int64, "run_place": np.uint32}, {"key": np.uint64, "doc": np.int64, "place": np.uint32})
#: Upper 48 bits of a hash stand for a block: whatever else they let through, the second pass does not.
LOW16 = np.uint64((1 << 16) - 1)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of bytes other than ASCII white space."""
    return (text or "").encode().split()


def _batches(batches: Iterator[pa.RecordBatch], *more: str):
    """(keys, ids, word hashes, lists of the columns ``more``) of documents
    until a number of words is reached."""
    hashes = WordHashes()
    keys, ids, held, rest, size = [], [], [], [[] for _ in more], 0
    for batch in batches:
        for key, doc, text, *others in zip(*[texts(batch.column(c)) for c in ("key", "doc", "text", *more)], strict=True):
            keys.append(key)
            ids.append(doc)
            held.append(hashes.of(words_of(text)))
            for column, x in zip(rest, others, strict=True):
                column.append(x)
            size += len(held[-1]) + 1
            if size >= BATCH_WORDS:
                yield np.array(keys, np.int64).view(np.uint64), np.array(ids, np.int64), held, *rest
                keys, ids, held, rest, size = [], [], [], [[] for _ in more], 0
                trim()
    if keys:
        yield np.array(keys, np.int64).view(np.uint64), np.array(ids, np.int64), held, *rest
        trim()


def _gathered(back: DataFrame) -> DataFrame:
    """(cut_key, cut_doc, places) of the rows that went back, a row for each document."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        got = BACK.of(pdf)[0]
        order = np.lexsort((got["place"], got["doc"], got["key"]))
        key, doc, place = (got[x][order] for x in ("key", "doc", "place"))
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        ends = np.r_[first[1:], len(key)]
        trim()
        return pd.DataFrame({"cut_key": key[first].view(np.int64), "cut_doc": doc[first], "places": [squeeze_sorted(place[a:b]) for a, b in zip(first, ends, strict=True)]})

    return back.groupBy("frag").applyInPandas(gather, "cut_key long, cut_doc long, places binary")


def anchors(rows: DataFrame, plan: list[int], window: int = WINDOW) -> DataFrame:
    """(cut_key, cut_doc, places): numbers of the blocks of each document (key,
    doc, text) that a second place shares."""
    block = window // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, held in _batches(batches):
            probes, index, owners, at = [], [], [], []
            for i, w in enumerate(held):
                if len(w) >= window:
                    h = rolling(w, block) & ~LOW16
                    probes.append(h)
                    index.append(h[::block])
                    owners.append(np.full(len(index[-1]), i, np.int64))
                    at.append(np.arange(len(index[-1]), dtype=np.uint32))
            if not probes:
                continue
            probe, times = np.unique(np.concatenate(probes), return_counts=True)
            h, owner, at = np.concatenate(index), np.concatenate(owners), np.concatenate(at)
            spot = np.searchsorted(probe, h)
            flags = (times > 1).astype(np.uint8)
            flags[spot] |= 2
            order = np.argsort(spot, kind="stable")
            order = order[times[spot[order]] == 1]
            known = times[spot] > 1
            yield PROBES.rows(
                plan[0], {"probe": probe, "flags": flags}, {"block": h[order], "owner": keys[owner[order]], "at": at[order]}, {"key": keys[owner[known]], "doc": ids[owner[known]], "place": at[known]}
            )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        probes, blocks, back = PROBES.of(pdf)
        order = np.argsort(probes["probe"], kind="stable")
        h, flags = probes["probe"][order], probes["flags"][order]
        if len(h):
            first = starts(h)
            some = np.bitwise_or.reduceat(flags, first)
            several = np.diff(np.r_[first, len(h)]) > 1
            hit = h[first][(some >= 2) & (several | (some & 1 > 0))]
            if len(hit) and len(blocks["block"]):
                there = hit[np.minimum(np.searchsorted(hit, blocks["block"]), len(hit) - 1)] == blocks["block"]
                more = {"key": blocks["owner"][there], "doc": np.zeros(there.sum(), np.int64), "place": blocks["at"][there]}
                back = {x: np.r_[back[x], more[x]] for x in back}
        back["doc"] = np.zeros(len(back["key"]), np.int64)  # the key alone will do: the second pass is exact whatever it gets
        order = np.lexsort((back["place"], back["key"]))
        trim()
        return BACK.rows(plan[0], {x: a[order] for x, a in back.items()}).to_pandas()

    sent = PROBES.deal(rows.mapInArrow(scan, PROBES.schema), plan)
    return _gathered(BACK.deal(sent.groupBy("frag").applyInPandas(join, BACK.schema), plan)).drop("cut_doc")


def repeated(rows: DataFrame, plan: list[int], window: int = WINDOW) -> DataFrame:
    """(cut_key, cut_doc, places): windows of each document (key, doc, text,
    places of anchors) that have an earlier equal, in the order of (doc, key,
    place)."""
    block = window // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, held, places in _batches(batches, "places"):
            runs, owners, at = [], [], []
            for i, (w, packed) in enumerate(zip(held, places, strict=True)):
                n = len(w) - window + 1
                if n <= 0:
                    continue
                near = (unsqueeze_sorted(packed, np.uint32).astype(np.int64) * block)[:, None] - np.arange(window - block + 1)
                spots = np.unique(near[(near >= 0) & (near < n)])
                if len(spots):
                    runs.append(_runs(w, window, spots))
                    owners.append(np.full(len(spots), i, np.int64))
                    at.append(spots.astype(np.uint32))
            if not runs:
                continue
            h, owner, at = np.concatenate(runs), np.concatenate(owners), np.concatenate(at)
            order = np.lexsort((at, keys[owner], ids[owner], h))
            h, key, doc, at = h[order], keys[owner[order]], ids[owner[order]], at[order]
            head, later = _earliest(h, key, doc, at)
            yield RUNS.rows(plan[0], {"run": h[head], "run_key": key[head], "run_doc": doc[head], "run_place": at[head]}, {"key": key[later], "doc": doc[later], "place": at[later]})

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        got, back = RUNS.of(pdf)
        order = np.lexsort((got["run_place"], got["run_key"], got["run_doc"], got["run"]))
        h, key, doc, at = (got[x][order] for x in ("run", "run_key", "run_doc", "run_place"))
        _, later = _earliest(h, key, doc, at)
        back = {"key": np.r_[back["key"], key[later]], "doc": np.r_[back["doc"], doc[later]], "place": np.r_[back["place"], at[later]]}
        order = np.lexsort((back["place"], back["doc"], back["key"]))
        trim()
        return BACK.rows(plan[0], {x: a[order] for x, a in back.items()}).to_pandas()

    sent = RUNS.deal(rows.mapInArrow(scan, RUNS.schema), plan)
    return _gathered(BACK.deal(sent.groupBy("frag").applyInPandas(judge, BACK.schema), plan))


def _earliest(h: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places, in order, are the earliest of their hash, and which
    are later.  A repeated row has its windows at the places of the first one:
    equal places are one, neither earlier than the other."""
    if not len(h):
        return np.empty(0, bool), np.empty(0, bool)
    head = np.r_[True, h[1:] != h[:-1]]
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    same = (key == key[at]) & (doc == doc[at]) & (place == place[at])
    return head, ~same


def _runs(w: np.ndarray, window: int, spots: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``spots``."""
    h = rolling(w, window)[spots]
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(31))) * (MULT ^ MULT2 | np.uint64(1))


def covered(n: int, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words the windows starting at ``at`` cover."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + window, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _keyed(id_col: str, text_col: str):
    """Columns key and doc of a row: a hash of id and text, and the id (null:
    the least of all) that windows are ordered by."""
    doc = F.col(id_col).cast("long")
    return F.xxhash64(doc, text_col, doc.isNull()).alias("key"), F.coalesce(doc, F.lit(-(1 << 63))).alias("doc")


def _beside(rows: DataFrame, found: DataFrame, on, how: str) -> DataFrame:
    """Rows with what was found for them, broadcast if it is small."""
    size = found.agg(F.sum(F.octet_length("places") + 40)).first()[0] or 0
    return rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, on, how)


def _with_starts(df: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", fan: int | None = None) -> DataFrame:
    """``df`` with ``cut_starts`` beside each row (null: nothing repeats)."""
    spark = df.sparkSession
    rows = df.select(*_keyed(id_col, text_col), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = stages(fragments(spark, size, BYTES_EACH), fan)
    hits = cut(anchors(rows, plan, window), "substring-anchors")
    near = _beside(rows, hits, F.col("key") == F.col("cut_key"), "inner").select("key", "doc", "text", "places")
    found = cut(repeated(near, plan, window), "substring-starts")
    key, doc = _keyed(id_col, text_col)
    marked = _beside(df.withColumn("own_key", key).withColumn("own_doc", doc), found, (F.col("own_key") == F.col("cut_key")) & (F.col("own_doc") == F.col("cut_doc")), "left")
    return marked.withColumnRenamed("places", "cut_starts").drop("own_key", "own_doc", "cut_key", "cut_doc")


def dedup_substrings(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", fan: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Removed is each word within ``window`` consecutive words that also start
    earlier: in a smaller id, or before in the same document; judged on the
    input.  Null texts have no words.  Rows that repeat an id with equal text
    are one document to this rule and keep the same words; rows that repeat an
    id with another text are documents of their own, in the order of a hash of
    the text.  A null id ranks like the least id there is and stays null.
    Very long texts are whole documents.  An empty table gives none.
    """
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(texts(batch.column("text")), texts(batch.column("cut_starts")), strict=True):
                words = words_of(text)
                gone = 0
                if starts is not None:
                    mask = covered(len(words), _starts(starts, len(words), window), window)
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                out.append((len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            n, gone, digest = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(n), pa.int64()), pa.array(list(gone), pa.int64()), pa.array(list(digest), pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            trim()

    return _with_starts(rows, window, fan=fan).select("doc_id", "text", "cut_starts").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _starts(packed: bytes, n: int, window: int) -> np.ndarray:
    at = unsqueeze_sorted(packed, np.uint32).astype(np.int64)
    return at[at <= n - window]


def strip_repeats(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` (columns doc_id, text, n_chars and others) without
    repeated words: a changed text is its kept words joined by one space; a
    text with nothing left goes, one with nothing removed stays as it is.

    Ids, nulls, repeated rows and very long texts are as in
    ``dedup_substrings``; null texts and texts without words stay; an empty
    table gives none; other columns, whatever their names, go along.
    """
    had, schema = df.columns, df.schema
    df, restore = shield(df, "doc_id", "text", "n_chars")
    marked = _with_starts(df, window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(texts(batch.column("text")), texts(batch.column("cut_starts")), strict=True):
                if starts is not None:
                    words = words_of(text)
                    mask = covered(len(words), _starts(starts, len(words), window), window)
                    if mask.any():
                        text = b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m).decode()
                        text = text or None
                        out.append((text, text is not None))
                        continue
                out.append((text, True))
            at = batch.schema.names.index("text")
            done = batch.set_column(at, batch.schema.field(at), pa.array([x[0] for x in out], batch.schema.field(at).type))
            yield done.filter(pa.array([x[1] for x in out], pa.bool_()))
            del out, done
            trim()

    marked = marked.select(*df.columns, "cut_starts")
    out = marked.mapInArrow(keep, marked.schema).select(*df.columns)
    if "n_chars" in had:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return restore(out)
