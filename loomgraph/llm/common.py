"""Helpers shared by the corpus operators: hashing, packing, shared storage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixers.
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and all run in one process (tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(_drop_local, _LOCAL)
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Ends the lineage: a lost executor later re-reads files instead of
    recomputing what led to them, and a result used twice is computed once.
    All tables of an application lie below one folder, which can go when the
    application has ended.  ``by`` names a column to partition the files by.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of ``df`` by exact name under the names of the keywords; other
    columns, whatever they are called, cannot clash with them."""
    names = df.columns
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])
    return safe.select(*[F.col(f"c{names.index(source)}").alias(name) for name, source in wanted.items()])


def shield(df: DataFrame, *known: str):
    """``df`` with all columns but ``known`` under names that operators do not
    use, and a function that gives a result its columns back."""
    names = df.columns
    inner = [n if n in known else f"other_{i}" for i, n in enumerate(names)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*names)


#: Copies of one row that one task makes.
COPIES_EACH = 10_000


def expand(df: DataFrame, times: str, nr: str, most: int) -> DataFrame:
    """Each row of ``df`` as often as its column ``times`` says (``most`` at
    most), numbered from 0 in column ``nr``; many copies of one row are dealt
    to several tasks."""
    first, last = F.lit(0).cast("long"), F.col(times).cast("long") - 1
    few = df.where(F.col(times).between(1, COPIES_EACH)).withColumn(nr, F.explode(F.sequence(first, last)))
    if most <= COPIES_EACH:
        return few
    many = df.where(F.col(times) > COPIES_EACH).withColumn(nr, F.explode(F.sequence(first, last, F.lit(COPIES_EACH).cast("long"))))
    many = many.repartition(nr, times).withColumn(nr, F.explode(F.sequence(F.col(nr), F.least(F.col(nr) + COPIES_EACH - 1, last))))
    return few.unionByName(many)


#: Rows of one range of ``running``.
RANGE_ROWS = 100_000


def running(df: DataFrame, order: list, label: str, **sums: Column) -> DataFrame:
    """``df`` with column ``before``, how many rows come before each in
    ``order`` (which must tell all rows apart), and a column for each keyword,
    the sum of its expression over those rows.

    Rows are sorted in ranges of about ``RANGE_ROWS``, each a window of its
    own; only the ranges' totals, a row for each, meet in one task."""
    n = -(-df.count() // RANGE_ROWS)
    ranged = df.repartitionByRange(max(1, n), *order).withColumn("range_", F.spark_partition_id())
    ranged = cut(ranged, label)
    sums = {"before": F.lit(1).cast("long")} | sums
    own = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range_").agg(*[F.sum(x).alias(f"{name}_") for name, x in sums.items()])
    offsets = totals.select("range_", *[F.coalesce(F.sum(f"{name}_").over(ranges), F.lit(0)).alias(f"{name}_") for name in sums])
    out = ranged.select("*", *[F.coalesce(F.sum(x).over(own), F.lit(0)).alias(name) for name, x in sums.items()]).join(F.broadcast(offsets), "range_")
    return out.select(*df.columns, *[(F.col(name) + F.col(f"{name}_")).alias(name) for name in sums])


def fragments(spark: SparkSession, size: int, size_each: int) -> int:
    """How many hash fragments to cut work of some size into: grows with the
    input, at least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // size_each))


def texts(column: pa.Array) -> Iterator[str | None]:
    """Values of a column, a few at a time as Python strings."""
    for at in range(0, len(column), 200):
        yield from column.slice(at, 200).to_pylist()


def trim() -> None:
    """Give freed memory of this worker, which later tasks use, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered up to a fixed number of words."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MULT2
        h = (h ^ (h >> np.uint64(27))) * MULT
        return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (empty if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, k):
            h *= MULT
            h += words[j : n + j]
    return mix(h)


def fragment_of(h: np.ndarray, n: int) -> np.ndarray:
    """Fragment 0..n-1 of each hash, by its upper 24 bits."""
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


#: Rows that a batch is cut into at most.
FAN = 1024


def stages(n: int, fan: int | None = None) -> list[int]:
    """Numbers of fragments, each a multiple of the one before it by at most
    ``fan``, the last one at least ``n``."""
    fan, k = fan or FAN, 1
    while fan**k < n:
        k += 1
    each = next(r for r in range(1, fan + 1) if r**k >= n)
    return [each**i for i in range(1, k + 1)]


class Packed:
    """Groups of equally long integer arrays that travel as one row for each
    hash fragment; a group is a dict of names and dtypes, the first of them a
    64-bit hash that decides the fragment.

    A batch is cut into ``stages(n)[0]`` rows, at most ``FAN``; where there
    are more fragments, ``deal`` gathers rows of one coarse fragment, wherever
    they come from, and cuts them again.  So rows grow with the data, not with
    batches times fragments.
    """

    def __init__(self, *groups: dict[str, type], batch: int = 1_000_000):
        self.groups = [{n: np.dtype(k) for n, k in g.items()} for g in groups]
        self.names = [n for g in self.groups for n in g]
        self.schema = "frag int, " + ", ".join(f"{n} binary" for n in self.names)
        self.batch = batch

    def rows(self, n: int, *groups: dict[str, np.ndarray]) -> pa.RecordBatch:
        """One row for each of ``n`` fragments that has entries, in their order."""
        cells: dict[int, dict[str, bytes]] = {}
        for kinds, group in zip(self.groups, groups, strict=True):
            frag = fragment_of(group[next(iter(kinds))], n)
            ordered = {name: group[name].astype(kind, copy=False) for name, kind in kinds.items()}
            if (frag[1:] < frag[:-1]).any():
                order = np.argsort(frag, kind="stable")
                frag, ordered = frag[order], {name: x[order] for name, x in ordered.items()}
            at = np.searchsorted(frag, np.arange(n + 1))
            for f in np.flatnonzero(np.diff(at)).tolist():
                cells.setdefault(f, {}).update((name, squeeze_sorted(x[at[f] : at[f + 1]])) for name, x in ordered.items())
        arrays = [pa.array(list(cells), pa.int32()), *[pa.array([c.get(name) for c in cells.values()], pa.binary()) for name in self.names]]
        return pa.RecordBatch.from_arrays(arrays, names=["frag", *self.names])

    def arrays(self, cells: dict[str, list[bytes | None]]) -> list[dict[str, np.ndarray]]:
        """The groups of rows (lists of cells by name), one row after the other."""
        return [{n: np.concatenate([np.empty(0, k), *[unsqueeze_sorted(x, k) for x in cells[n] if x is not None]]) for n, k in g.items()} for g in self.groups]

    def of(self, pdf: pd.DataFrame) -> list[dict[str, np.ndarray]]:
        return self.arrays({n: pdf[n].tolist() for n in self.names})

    def deal(self, sent: DataFrame, plan: list[int]) -> DataFrame:
        """Rows cut into ``plan[0]`` fragments, cut into ``plan[-1]``."""
        parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for had, n in zip(plan, plan[1:], strict=False):
            salt = F.pmod(F.monotonically_increasing_id(), F.lit(max(1, parts // had)))
            sent = sent.withColumn("salt", salt).repartition("frag", "salt").drop("salt").sortWithinPartitions("frag").mapInArrow(self._again(n), self.schema)
        return sent

    def _again(self, n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, size = None, {name: [] for name in self.names}, 0
            for batch in batches:
                for row in batch.to_pylist():
                    if held[self.names[0]] and (row["frag"] != now or size >= self.batch):
                        yield self.rows(n, *self.arrays(held))
                        held, size = {name: [] for name in self.names}, 0
                        trim()
                    now = row["frag"]
                    for name in self.names:
                        held[name].append(row[name])
                    size += sum(length(row[next(iter(g))], next(iter(g.values()))) for g in self.groups)
            if held[self.names[0]]:
                yield self.rows(n, *self.arrays(held))

        return run


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array, byte planes apart, compressed."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    planes = raw.reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(a: np.ndarray) -> bytes:
    """As ``squeeze``, best for sorted values: differences are stored."""
    d = a.copy()
    with np.errstate(over="ignore"):
        d[1:] -= a[:-1]
    return squeeze(d)


def unsqueeze_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unsqueeze(b, dtype), dtype=dtype)


def length(b: bytes | None, dtype) -> int:
    """Entries of a squeezed array."""
    return 0 if b is None else zstandard.frame_content_size(b) // np.dtype(dtype).itemsize


def starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
