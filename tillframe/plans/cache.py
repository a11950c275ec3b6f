"""Cached tables that follow their files.

A result is kept with the state of the files it was read from: their paths, lengths and
times, as the file system lists them. When any of these has changed the next request
builds it anew, from a fresh listing, and what is no longer valid leaves memory. What is
kept is bounded in bytes; the least recently used goes first.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

State = frozenset[tuple[str, int, int]]


def file_state(spark: SparkSession, *paths: str) -> State:
    """(path, length, time of change) of every file below the paths, markers and hidden ones left out; a path that isn't there has none."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(conf)
        if not system.exists(at):
            continue
        files = system.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return frozenset(found)


@dataclass
class Entry:
    state: State
    df: DataFrame
    size: int


class FileCache:
    """Results by (name, what else tells them apart, such as filters), valid as long as their files are as they were."""

    def __init__(self, spark: SparkSession, max_bytes: int = 1 << 30, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.spark, self.max_bytes, self.level = spark, max_bytes, level
        self.entries: OrderedDict[tuple, Entry] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: tuple, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The result of build, kept from an earlier call if no file below the paths has changed since.

        It is computed at once, as its size is known only then; one larger than the whole
        cache is returned and not kept. build should read the paths itself, so that it
        sees the files there are now.
        """
        state = file_state(self.spark, *paths)
        entry = self.entries.get(key)
        if entry and entry.state == state:
            self.entries.move_to_end(key)
            self.hits += 1
            return entry.df
        self.misses += 1
        self.drop(key)
        for path in paths:
            self.spark.catalog.refreshByPath(path)
        df = build().persist(self.level)
        df.count()
        size = int(str(df._jdf.queryExecution().withCachedData().stats().sizeInBytes()))
        if size > self.max_bytes:
            df.unpersist()
            return build()
        self.entries[key] = Entry(state, df, size)
        while self.size > self.max_bytes:
            self.drop(next(iter(self.entries)))
        return df

    @property
    def size(self) -> int:
        return sum(e.size for e in self.entries.values())

    def drop(self, key: tuple) -> None:
        if entry := self.entries.pop(key, None):
            entry.df.unpersist()

    def invalidate(self, name: str) -> None:
        """Forget all results of one name, as after a change that no file shows."""
        for key in [k for k in self.entries if k[0] == name]:
            self.drop(key)

    def clear(self) -> None:
        for key in list(self.entries):
            self.drop(key)
