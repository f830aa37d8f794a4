"""Media columns: content-defined chunks in a deduplicated store.

A payload becomes a mono 8-bit PCM WAV file; the file is cut where a rolling
gear hash of the last 32 bytes has its upper bits zero; chunks are named by
their SHA-256.  One scan yields digests only.  Spark joins on digests find the
one holder of each chunk (the smallest document id and place); the store is
then written by a second scan in which a document keeps the bytes of the
chunks it holds and refers to others by digest.  Reading back, a document
gathers what it refers to by a join on digests, puts the ordered list
together, verifies the file's digest and decodes it.  Bytes that are not
shared never pass a shuffle.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut

#: Bytes of a chunk: none shorter (but a file's last) or longer, about AVERAGE + LEAST.
LEAST, AVERAGE_BITS, MOST = 1024, 12, 16384
RATE = 8000
#: Bytes of the lists of borrowed chunks beyond which they are no longer broadcast, and those of one chunk in them.
BROADCAST_BYTES, LINK_BYTES = 32 << 20, 80

#: 256 numbers of 32 bits for the gear hash, from a digest of each byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those padded by zeros to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 if raw else 64)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:  # h[i] = sum of gear[b[i-j]] << j for j < span, doubled each turn
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - AVERAGE_BITS)) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(marks, start + LEAST)
        end = int(marks[i]) if i < len(marks) else n
        start = min(end, start + MOST, n)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def feature(samples: bytes) -> str:
    """Mean level, loudness and crossings of the middle line, of all samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


def _map(df: DataFrame, one, schema: str, arrow: pa.Schema) -> DataFrame:
    """``one`` (a dict of a row) -> list of dicts, over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = [y for x in batch.slice(at, 1000).to_pylist() for y in one(x)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def chunk_index(df: DataFrame) -> DataFrame:
    """(doc_id, idx, digest) of every chunk of every row (doc_id, text)."""

    def one(x):
        return [{"doc_id": x["doc_id"], "idx": i, "digest": hashlib.sha256(c).digest()} for i, c in enumerate(chunks(to_wav(payload(x["text"])[1])))]

    return _map(df, one, "doc_id long, idx int, digest binary", pa.schema([("doc_id", pa.int64()), ("idx", pa.int32()), ("digest", pa.binary())]))


CHUNK = "array<struct<digest: binary, bytes: binary, salts: int>>"
CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary()), ("salts", pa.int32())]))
#: References to one chunk that one task serves; a chunk with more is dealt to several.
REFERENCES_EACH = 100
#: Copies of one chunk that one task makes for those.
LENT_EACH = 1000


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads of all rows; returns the stored files: doc_id,
    n_bytes, media_sha256, chunks (digest, bytes or null if another document
    or an earlier place holds them, salts: over 0 if shared), borrows.
    """
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    index = cut(chunk_index(rows), "media-index")
    # a struct, as its nulls sort first: a row without an id may hold chunks too
    refs = index.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("holder"), F.max(F.struct("doc_id")).alias("other"), F.count(F.lit(1)).alias("n"))
    shared = cut(refs.where(~F.col("holder").eqNullSafe(F.col("other"))).select("digest", "holder", F.ceil(F.col("n") / REFERENCES_EACH).cast("int").alias("salts")), "media-shared")
    mine = F.struct("doc_id").eqNullSafe(F.col("holder"))
    links = index.join(shared, "digest").groupBy("doc_id").agg(F.collect_set(F.struct("digest", "salts", mine.alias("mine"))).alias("links"))
    links = cut(links.withColumnRenamed("doc_id", "link_id"), "media-links")
    size = links.agg(F.sum(F.size("links") + 1)).first()[0] or 0
    side = F.broadcast(links) if size * LINK_BYTES <= BROADCAST_BYTES else links
    marked = rows.join(side, F.col("doc_id").eqNullSafe(F.col("link_id")), "left").select("doc_id", "text", "links")

    def one(x):
        n_bytes, raw = payload(x["text"])
        media = to_wav(raw)
        links = {y["digest"]: y for y in x["links"] or ()}
        parts, own, borrows = [], set(), False
        for c in chunks(media):
            digest = hashlib.sha256(c).digest()
            link = links.get(digest)
            away = link is not None and not link["mine"]
            borrows |= away
            parts.append({"digest": digest, "bytes": None if away or digest in own else c, "salts": link["salts"] if link else 0})
            own.add(digest)
        return [{"doc_id": x["doc_id"], "n_bytes": n_bytes, "media_sha256": hashlib.sha256(media).hexdigest(), "chunks": parts, "borrows": borrows}]

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("chunks", CHUNKS), ("borrows", pa.bool_())])
    return cut(_map(marked, one, f"doc_id long, n_bytes long, media_sha256 string, chunks {CHUNK}, borrows boolean", arrow), "media-files")


def read(files: DataFrame) -> DataFrame:
    """``files`` with the bytes held elsewhere beside: column ``extra``."""
    kind = "array<struct<digest: binary, bytes: binary>>"
    alone = files.where(~F.col("borrows")).withColumn("extra", F.lit(None).cast(kind))
    needy = files.where("borrows")
    missing = F.filter("chunks", lambda c: c["bytes"].isNull() & (c["salts"] > 0))
    wants = needy.select("doc_id", F.explode(F.array_distinct(missing)).alias("c")).select("doc_id", "c.digest", "c.salts").distinct()
    wants = wants.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    lenders = files.select(F.explode(F.filter("chunks", lambda c: c["bytes"].isNotNull() & (c["salts"] > 0))).alias("c")).select("c.digest", "c.bytes", "c.salts")
    # copies of one chunk are made by several tasks, LENT_EACH by each; a repeated row holds the same bytes
    lenders = lenders.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1, F.lit(LENT_EACH))))
    lenders = lenders.groupBy("digest", "salts", "first").agg(F.first("bytes").alias("bytes"))
    lenders = lenders.select("digest", "bytes", F.explode(F.sequence("first", F.least(F.col("first") + LENT_EACH, "salts") - 1)).alias("salt"))
    got = wants.join(lenders, ["digest", "salt"]).groupBy(F.col("doc_id").alias("want_id")).agg(F.collect_list(F.struct("digest", "bytes")).alias("extra"))
    filled = needy.join(got, F.col("doc_id").eqNullSafe(F.col("want_id")), "left").drop("want_id")
    return alone.unionByName(filled)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media, read them back and describe what was read.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last
    64 bytes), media_bytes, media_sha256, feature, n_chunks.  Null text is
    empty: 64 zero bytes.  Very long texts are more chunks; repeated rows and
    copies share theirs; null ids are rows like others.  A file whose digest
    does not match after reading raises an error.  An empty table gives none.
    """

    def one(x):
        held = {c["digest"]: c["bytes"] for c in [*(x["extra"] or ()), *x["chunks"]] if c["bytes"] is not None}
        parts = [held[c["digest"]] for c in x["chunks"]]
        media = b"".join(parts)
        if hashlib.sha256(media).hexdigest() != x["media_sha256"]:
            raise ValueError(f"media of document {x['doc_id']} do not match their digest")
        raw = from_wav(media)
        return [{
            "doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).hexdigest(),
            "tail_crc32": zlib.crc32(raw[-64:]), "media_bytes": len(media), "media_sha256": x["media_sha256"], "feature": feature(raw), "n_chunks": len(parts),
        }]

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    arrow = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32()),
    ])
    return _map(read(store(df, id_col, text_col)), one, schema, arrow)
