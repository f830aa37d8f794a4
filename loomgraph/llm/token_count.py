"""Token counts without ids: pieces are counted once for each distinct pre-token.

A scan turns texts into (pre-token, document, frequency), packed by hash
fragment of the pre-token: the strings once per batch, the numbers beside
them.  The join on pre-tokens happens inside a fragment, where each distinct
string is tokenised once; a fragment returns one partial sum for each of a
batch's documents it met, and the sums per document are added.

A batch is cut into at most ``FAN`` rows, so rows grow with the data.  Beyond
that many fragments' worth of documents, batches are dealt into groups, each
with fragments of its own: a pre-token is then counted once in each group, and
one that nearly every document holds meets only a group's documents at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import tokens
from loomgraph.llm.common import FAN, columns, fragments, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted

LIMIT = 2048
#: Pre-token occurrences that a batch gathers before it is packed.
BATCH_WORDS = 3_000_000
#: Texts that a batch gathers, however short they are.
BATCH_DOCS = 1_000_000
#: Documents for one fragment at least; there is one for each shuffle partition anyway.
DOCS_EACH = 6000


def count_tokens(df: DataFrame, tokenizer: str = "word_bpe_49k.json", folder: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row.

    Null and empty texts have 0 tokens.  Repeated rows and null ids are
    counted each; very long texts are one document like any other.  Other
    columns are ignored; an empty table gives none.  Rows keep their place by
    a key of partition and running number, so equal ids cannot mix.
    """
    spark = df.sparkSession
    wanted = fragments(spark, df.count(), DOCS_EACH)
    n, groups = min(wanted, FAN), -(-wanted // FAN)
    rows = columns(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, batch = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        index: dict[str, int] = defaultdict(counter().__next__)
        words = 0
        for rows_in in batches:
            for doc, text in zip(rows_in.column("doc_id").to_pylist(), rows_in.column("text").to_pylist(), strict=True):
                pre = tokens.pre_tokens(text, tokenizer, folder)
                ids.append(doc)
                sizes.append(len(text.encode()))
                held.append(np.fromiter(map(index.__getitem__, pre), np.int64, len(pre)))
                words += len(pre)
                if words >= BATCH_WORDS or len(ids) >= BATCH_DOCS:
                    yield _pack((part << 24) + batch, ids, sizes, held, list(index), n, groups)
                    batch += 1
                    ids, sizes, held, words = [], [], [], 0
                    index = defaultdict(counter().__next__)
        if ids:
            yield _pack((part << 24) + batch, ids, sizes, held, list(index), n, groups)

    packed = rows.mapInArrow(scan, "batch long, frag long, words binary, docs binary, places binary, freqs binary")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # frag -1 - x: the list of a batch's documents, passed through
        if pdf["frag"].iat[0] < 0:
            return pdf[["batch", "docs", "places"]].rename(columns={"docs": "a", "places": "b"}).assign(kind=0)
        known: dict[str, int] = {}
        out = []
        for row in pdf.itertuples():
            strings = zstandard.ZstdDecompressor().decompress(row.words).decode("utf-8", "surrogatepass").split("\n") if row.words else []
            new = [w for w in strings if w not in known]
            known.update(zip(new, tokens.piece_counts(new, tokenizer, folder), strict=True))
            pieces = np.fromiter((known[w] for w in strings), np.int64, len(strings))
            keys = unsqueeze_sorted(row.docs, np.uint32).astype(np.int64)  # document of each entry
            places = unsqueeze(row.places, np.uint32)
            sums = np.bincount(keys, weights=pieces[places] * unsqueeze(row.freqs, np.uint32).astype(np.int64))
            met = np.flatnonzero(sums)
            out.append((row.batch, squeeze_sorted(met.astype(np.uint32)), squeeze(sums[met].astype(np.uint64)), 1))
        return pd.DataFrame(out, columns=["batch", "a", "b", "kind"])

    parts = packed.groupBy("frag").applyInPandas(solve, "batch long, a binary, b binary, kind int")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["kind"] == 0].iloc[0]
        ids, sizes = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64)
        null = sizes < 0
        sums = np.zeros(len(ids), np.int64)
        for row in pdf[pdf["kind"] == 1].itertuples():
            sums[unsqueeze_sorted(row.a, np.uint32)] += unsqueeze(row.b, np.uint64).astype(np.int64)
        return pd.DataFrame({"doc_id": ids, "n_bytes": np.where(null, -sizes - 1, sizes), "n_tokens": sums, "null_id": null})

    done = parts.groupBy("batch").applyInPandas(total, "doc_id long, n_bytes long, n_tokens long, null_id boolean")
    return done.select(
        F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
    )


def _pack(batch: int, ids: list, sizes: list[int], held: list[np.ndarray], strings: list[str], n: int, groups: int) -> pa.RecordBatch:
    """One row for each fragment of the batch's group, and one (frag < 0) with
    the documents; a null id is marked by a negative size."""
    first = xxhash.xxh3_64_intdigest(str(batch)) % groups * n
    null = np.array([x is None for x in ids])
    doc_ids = np.array([x or 0 for x in ids], np.int64)
    n_bytes = np.where(null, -np.array(sizes, np.int64) - 1, np.array(sizes, np.int64))
    out = [(batch, -1 - first - batch % n, b"", doc_ids.tobytes(), n_bytes.tobytes(), b"")]
    docs = np.repeat(np.arange(len(held)), [len(h) for h in held])
    pre = np.concatenate(held) if held else np.empty(0, np.int64)
    frag = np.fromiter((xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) % n for s in strings), np.int64, len(strings))
    # (fragment, document, pre-token) once each, with its frequency
    width = np.int64(max(1, len(strings)))
    by_frag = np.argsort(frag, kind="stable")
    place = np.empty(len(strings), np.int64)
    place[by_frag] = np.arange(len(strings))  # pre-tokens renumbered fragment by fragment
    bounds = np.searchsorted(frag[by_frag], np.arange(n + 1))
    keys, freqs = np.unique(docs * width + place[pre], return_counts=True)
    at_doc, at_place = keys // width, keys % width
    owner = frag[by_frag][at_place] if len(strings) else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    at_doc, at_place, freqs, owner = at_doc[order], at_place[order], freqs[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    press = zstandard.ZstdCompressor(level=3)
    for f in range(n):
        a, b = cuts[f], cuts[f + 1]
        if a == b:
            continue
        own = "\n".join(strings[i] for i in by_frag[bounds[f] : bounds[f + 1]])
        out.append((batch, first + f, press.compress(own.encode("utf-8", "surrogatepass")), squeeze_sorted(at_doc[a:b].astype(np.uint32)), squeeze((at_place[a:b] - bounds[f]).astype(np.uint32)), squeeze(freqs[a:b].astype(np.uint32))))
    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "frag", "words", "docs", "places", "freqs"])
