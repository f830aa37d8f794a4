"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Law ``rows``: every shard may hold floor(n/S) or ceil(n/S) rows, so counts are
at most one apart.  A row belongs to the arc of the ring its hash falls into;
where the shard of that arc is full, the surplus continues clockwise to the
next virtual node whose shard has room.  Only one count per arc (a fixed
number: shards x virtual nodes) reaches the driver; the overflow is solved on
these counts as intervals of ranks.  Ranks within an arc are taken in ranges of
the ring of about ``RANGE_ROWS`` rows; rows that are equal in all that is
returned are one item with a count until the end, so no task gets all of them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import columns, cut, expand

#: Virtual nodes of each shard.
VNODES = 128
#: Positions on the ring.
RING = 1 << 32
#: Rows of one range of ranks, about, and ranges up to which their table is broadcast (about 30 bytes each).
RANGE_ROWS, BROADCAST_RANGES = 50_000, 500_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    spots: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}:{v}".encode()).digest()[:4], "big")
            spots.setdefault(at, shard)
    return sorted(spots.items())


def place_counts(arcs: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, first rank, end rank, shard, first slot) for the number
    of rows in each arc.

    Room is floor(n/S) rows a shard, plus one for the shards met first on the
    ring until n rows have room.  Two clockwise turns: rows first go to their
    own arc's shard, then what is over moves on until it finds room.
    """
    n = sum(arcs)
    room = [n // shards] * shards
    for shard in list(dict.fromkeys(owners))[: n % shards]:
        room[shard] += 1
    filled = [0] * shards
    out, over = [], []
    for arc, count in enumerate(arcs):
        shard = owners[arc]
        took = min(count, room[shard] - filled[shard])
        if took:
            out.append((arc, 0, took, shard, filled[shard]))
            filled[shard] += took
        if took < count:
            over.append((arc, took, count))
    size = len(owners)
    for arc, rank, end in over:
        at = arc
        while rank < end:
            at = (at + 1) % size
            shard = owners[at]
            took = min(end - rank, room[shard] - filled[shard])
            if took:
                out.append((arc, rank, rank + took, shard, filled[shard]))
                filled[shard] += took
                rank += took
    return out


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """Put every row of ``df`` into one of ``shards`` shards (law ``rows``).

    Returns doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32
    (unsigned, null text: of the empty string), law, shard, slot (gapless from
    0 in each shard) and grown_shard (null: counts decide, not the key alone).

    Null ids, repeated rows and ties are ordinary rows: they rank by (ring
    position, id, crc, size), equal rows in any order, which makes no
    difference between them.  An empty table gives an empty result.  Columns
    other than the two named are ignored.
    """
    nodes = ring(shards, vnodes)
    spots, owners = [p for p, _ in nodes], [s for _, s in nodes]
    text = F.coalesce("text", F.lit(""))
    rows = columns(df, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    position = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 32)
    # first virtual node at or after the position; beyond the last one, the first
    arc = F.pmod(_bucket(position, spots), F.lit(len(spots)))
    keyed = rows.withColumn("position", position).withColumn("arc", arc.cast("int"))
    items = cut(keyed.groupBy("arc", "position", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("m")), "shard-items")
    facts = items.groupBy("arc").agg(F.sum("m").alias("n"), F.max("m").alias("most")).collect()
    counts, most = {r["arc"]: r["n"] for r in facts}, max((r["most"] for r in facts), default=0)
    plan = place_counts([counts.get(a, 0) for a in range(len(spots))], owners, shards)
    spans: dict[int, list] = {}
    for a, first, end, shard, slot in sorted(plan):
        spans.setdefault(a, []).append((end, shard, slot - first))
    # a fixed number of intervals (at most two for each arc and shard), as a literal table
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(a, [(e, s, o) for e, s, o in v]) for a, v in spans.items()] or [(-1, [])],
        "arc int, spans array<struct<end: long, shard: int, shift: long>>",
    )
    bits = min(32, max(0, (sum(counts.values()) // RANGE_ROWS).bit_length()))
    items = items.withColumn("range", F.shiftright("position", 32 - bits))
    ranges = items.groupBy("arc", "range").agg(F.sum("m").alias("k"))
    upto = Window.partitionBy("arc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(ranges.withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0))).drop("k"), "shard-ranges")
    order = Window.partitionBy("arc", "range").orderBy("position", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = items.withColumn("nth", F.coalesce(F.sum("m").over(order), F.lit(0))).join(F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges, ["arc", "range"])
    ranked = expand(ranked, "m", "nr", most).withColumn("rank", F.col("before") + F.col("nth") + F.col("nr"))
    hit = F.element_at(F.filter("spans", lambda x: x["end"] > F.col("rank")), 1)
    placed = ranked.join(F.broadcast(table), "arc").withColumn("hit", hit)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("hit.shard").alias("shard"),
        (F.col("rank") + F.col("hit.shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _bucket(position, spots: list[int]):
    """Index of the first spot at or after ``position``: a coarse table gives
    the range to look at, a short comparison the rest; all literals."""
    bits = 10
    low = [bisect_left(spots, b << (32 - bits)) for b in range(1 << bits)]
    table = F.array(*[F.lit(x) for x in low])
    every = F.array(*[F.lit(x) for x in spots])
    coarse = F.get(table, F.shiftright(position, 32 - bits).cast("int"))
    most = max(bisect_left(spots, (b + 1) << (32 - bits)) - low[b] for b in range(1 << bits))
    out = coarse
    for step in range(most):
        spot = F.get(every, coarse + F.lit(step))
        out = out + F.when(spot < position, 1).otherwise(0)
    return out
