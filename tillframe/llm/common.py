"""What several operators share: session settings, written tables, byte-level words, components.

Everything here keeps to three rules. A table that is read twice is written to the
shared checkpoint folder once, so a lost executor costs a re-read and not a re-run.
Python code sees Arrow batches and cuts them into chunks of about a megabyte, so a
worker's memory does not follow the batch. Nothing is collected except figures whose
number is fixed by a parameter.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import discard, shared_folder, written  # noqa: F401

CHUNK_BYTES = 1 << 20


#: Bytes of an Arrow batch at most, as texts can be very long; a smaller setting of the session stays.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that the session's Python functions are given, in both processes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    n = re.fullmatch(r"(\d+)b?", spark.conf.get(key).lower())
    if n is None or not 0 < int(n[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows, of a few numbers each, that are broadcast at most: some 64 MB.
MAX_BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be joined: broadcast behind a count of its rows, else the built side of a shuffled join."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table.hint("shuffle_hash")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bytes and words

#: What ends a word, and A-Z to a-z.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240611)
BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes x in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s, one longer than data: (s[e] - s[b]) * inverse_power[b] identifies data[b:e]."""
    up, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * up[:-1], out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin:end], by content and length alone."""
    _, down = powers(len(sums))
    h = (sums[end] - sums[begin]) * down[begin]
    h += (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together; a longer text is a range by itself."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words_of(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each word of data, which holds the texts at[0]..at[-1]."""
    inside = ~breaks[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = True, True
    edge[at] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    keep = inside[begin] if len(begin) else np.zeros(0, bool)
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(at, begin, "right") - 1


class HashTable:
    """Open addressing from distinct non-zero 64-bit hashes to small numbers over 0."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.size = 0
        self._room(len(hashes), values.dtype)
        self.add(hashes, values)

    def _room(self, n: int, kind: np.dtype) -> None:
        bits = max(4, int(2 * n).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, kind)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct hashes that are not there yet."""
        if 2 * (self.size + len(hashes)) > len(self.keys):
            held = np.flatnonzero(self.keys)
            hashes, values = np.concatenate([self.keys[held], hashes]), np.concatenate([self.values[held], values])
            self.size = 0
            self._room(2 * len(hashes), values.dtype)
        self.size += len(hashes)
        waiting, slot = np.arange(len(hashes)), hashes & self.mask
        while len(waiting):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[at], self.values[at] = hashes[waiting[placed]], values[waiting[placed]]
            rest = np.ones(len(waiting), bool)
            rest[placed] = False
            waiting, slot = waiting[rest], (slot[rest] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, 0 where it isn't in the table."""
        slot = hashes & self.mask
        found = self.keys[slot]
        out = np.where(found == hashes, self.values[slot], self.values.dtype.type(0))
        going = np.flatnonzero((found != hashes) & (found != 0))
        while len(going):
            slot[going] = (slot[going] + np.uint64(1)) & self.mask
            found = self.keys[slot[going]]
            hit = found == hashes[going]
            out[going[hit]] = self.values[slot[going[hit]]]
            going = going[~hit & (found != 0)]
        return out


def sample_ids(df: DataFrame, key: str, n: int) -> list:
    """At most n distinct keys, the least by hash: the bounded sample that models are fitted on."""
    return [r[0] for r in df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(n).collect()]


def carried(columns: list[str]) -> Column:
    """A caller's columns as one struct, so that none of their names meets an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("_"))


def schema_of(df: DataFrame, more: str, without: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without), more])


#: What a worker keeps from task to task, and for whom; workers outlive queries, so another owner's goes.
kept: dict = {}
_owner = [""]


def give_back() -> None:
    """Return freed memory to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def own(owner: str) -> None:
    """Claim what the worker keeps; what another owner has left goes."""
    if _owner[0] != owner:
        kept.clear()
        _owner[0] = owner
        give_back()


def batched(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], owner: str = ""):
    """A mapInArrow function from a function of one batch. Only tasks of one owner share what is kept."""

    def run(batches):
        own(owner)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()

    return run


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component_id) of every node of edges: component_id is the least node it reaches.

    Alternating large-star and small-star steps, each an aggregation and a join on the
    node; every round is written to the shared folder, where it replaces the last. Edges with a null end or equal
    ends are left out, repeated edges count once. No link leaves the executors: the
    driver sees one count and one checksum a round.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = written(links, name)
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, links = links, written(small_, name)
        discard(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
