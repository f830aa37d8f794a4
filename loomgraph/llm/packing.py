"""Packing documents into fixed-length sequences, balanced by attention cost.

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n^2.
Within a block of documents that a task holds, pieces go in descending order
to the sequence of lowest cost that still has room for them; a piece that no
sequence has room for is cut at the room of the cheapest open one.  A block
makes as many sequences as its tokens fill, and what remains opens the next
block; beside the last sequences of a partition, some that came out a few
tokens short of full are padded.  No shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import tokens
from loomgraph.llm.common import columns, texts, trim

ROOM = 2048
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
#: Tokens that a task holds before it packs them.
BLOCK_TOKENS = 1_000_000
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], room: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pack documents of these lengths.

    Returns pieces (document, start, length, sequence, offset) and what is
    left over, (document, start, length); with ``last`` nothing is left.
    """
    total = sum(lengths)
    n = -(-total // room) if last else total // room
    placed: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    seq = 0
    for doc, length in enumerate(lengths):  # what fills a sequence alone
        whole = length // room
        for i in range(whole):
            placed.append((doc, i * room, room, seq, 0))
            seq += 1
        if length % room:
            rest.append((doc, whole * room, length % room))
    n -= seq
    if n <= 0:
        return placed, rest
    rest.sort(key=lambda p: (-p[2], p[0]))
    # the costliest pieces go first; costs and room of the n open sequences
    costs, free = np.zeros(n), np.full(n, room)
    over: list[tuple[int, int, int]] = []
    for doc, start, length in rest:
        while length:
            fits = free >= length
            some = fits if fits.any() else free > 0
            if not some.any():
                over.append((doc, start, length))
                break
            at = int(np.argmin(np.where(some, costs, np.inf)))
            took = min(length, int(free[at]))
            placed.append((doc, start, took, seq + at, room - int(free[at])))
            free[at] -= took
            costs[at] += cost(took)
            start += took
            length -= took
    return placed, over


def pack(df: DataFrame, room: int = ROOM, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its ids and the end id; null text is empty, so just the end
    id.  Repeated rows and null ids are documents of their own.  A very long
    text is cut into whole sequences and a remainder.  Sequence ids are unique
    across partitions, not gapless.  An empty table gives no pieces.
    """
    rows = columns(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        docs: list[tuple[object, bytes, int, int]] = []  # id, ids from some start, that start, all tokens
        held = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal docs, held, base
            placed, over = assign([len(d[1]) // 4 for d in docs], room, last)
            out = []
            for doc, start, length, seq, offset in placed:
                name, ids, first, total = docs[doc]
                out.append((name, first + start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), total, base + seq, offset))
            base += 1 + max((p[3] for p in placed), default=-1)
            docs = [(docs[d][0], docs[d][1][4 * s : 4 * (s + n)], docs[d][2] + s, docs[d][3]) for d, s, n in over]
            held = sum(len(d[1]) // 4 for d in docs)
            columns = zip(*out, strict=True) if out else [[]] * len(FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=FIELDS)

        for batch in batches:
            for name, text in zip(texts(batch.column("doc_id")), texts(batch.column("text")), strict=True):
                ids = tokens.id_bytes(text, tokenizer, folder) + end
                docs.append((name, ids, 0, len(ids) // 4))
                held += len(ids) // 4
                if held >= block_tokens:
                    yield flush(False)
                    trim()
        if docs:
            yield flush(True)
            trim()

    return rows.mapInArrow(run, ", ".join(f"`{f}` long" for f in FIELDS))
