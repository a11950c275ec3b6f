"""Own state by key on a stream, and two streams joined with each other.

State lies in the RocksDB provider, so it is bounded by disk and not by memory, and is
restored from the checkpoint. Timers and watermarks are in event time.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The last amounts of a key that its list state holds.
RECENT = 3


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB; the session's setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Activity(StatefulProcessor):
    """For each key: number, sum and time of the last row (a value), rows by kind (a map), the last amounts (a list), and a timer."""

    def __init__(self, keys: int, gap_ms: int | None):
        self.row, self.gap_ms = Row(*(f"key{i}" for i in range(keys)), "what", "n", "total", "last_us", "kinds", "recent"), gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, total double, last_us long, timer_ms long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")
        self.recent = handle.getListState("recent", "us long, amount double")

    def _row(self, key: tuple, what: str, n: int, total: float, last_us: int, kinds: dict, recent: list) -> Row:
        return self.row(*key, what, n, total, last_us, kinds, [a for _, a in recent])

    def _kept(self) -> tuple[dict, list]:
        """The key's rows by kind, and its last amounts by time."""
        return {k[0]: v[0] for k, v in self.kinds.iterator()}, sorted(self.recent.get())

    def handleInputRows(self, key, rows, timerValues):
        # each call of a state goes to the executor and back: what is kept is read once, and only by a key that has some
        known = self.totals.get()
        n, total, last_us, timer_ms = known or (0, 0.0, None, None)
        kinds, recent = self._kept() if known else ({}, [])
        new = {}
        for row in rows:
            if row.us is None:
                continue
            valued = row.amount is not None and not math.isnan(row.amount)
            n, total = n + 1, total + (row.amount if valued else 0.0)
            last_us = row.us if last_us is None else max(last_us, row.us)
            if len(recent) < RECENT or row.us >= recent[0][0]:
                recent = sorted([*recent, (row.us, row.amount if valued else math.nan)])[-RECENT:]
            if row.kind is not None:
                new[row.kind] = new.get(row.kind, 0) + 1
        for kind, count in new.items():
            kinds[kind] = kinds.get(kind, 0) + count
            self.kinds.updateValue((kind,), (kinds[kind],))
        if recent:
            self.recent.put(recent)
        if self.gap_ms is not None and last_us is not None:
            due = last_us // 1000 + self.gap_ms
            if due != timer_ms:
                if timer_ms is not None:
                    self.handle.deleteTimer(timer_ms)
                self.handle.registerTimer(due)
            timer_ms = due
        self.totals.update((n, total, last_us, timer_ms))
        yield self._row(key, "total", n, total, last_us, kinds, recent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, total, last_us, _ = self.totals.get()
        self.totals.update((n, total, last_us, None))
        yield self._row(key, "inactive", n, total, last_us, *self._kept())

    def close(self) -> None:
        pass


def activity(stream: DataFrame, keys: dict[str, Column], ts: str, amount: Column, kind: Column, gap_ms: int | None = None, delay: str = "1 day") -> DataFrame:
    """Updates of each key's totals, and a row `inactive` when the watermark has passed its last row by gap_ms without another.

    (keys..., what, n, total, last_us, kinds map, recent array): last_us is the time of the
    last row in microseconds since 1970, recent the last amounts by time. Rows without a
    time count for nothing, null amounts add nothing. A hot key is one task: give a salt
    as a further key, and add up what comes out.
    """
    us = F.unix_micros(ts)
    rows = stream.withWatermark(ts, delay).select(F.col(ts).alias("at"), *(c.alias(f"k{i}") for i, c in enumerate(keys.values())), us.alias("us"), amount.cast("double").alias("amount"), kind.cast("string").alias("kind"))
    names = [f"k{i}" for i in range(len(keys))]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([*(f"key{i} {kinds[c]}" for i, c in enumerate(names)), "what string, n long, total double, last_us long, kinds map<string,long>, recent array<double>"])
    found = rows.groupBy(*names).transformWithState(Activity(len(keys), gap_ms), out, "Update", "None" if gap_ms is None else "EventTime")
    return found.select(*(F.col(f"key{i}").alias(k) for i, k in enumerate(keys)), "what", "n", "total", "last_us", "kinds", "recent")


def follow_ups(first: DataFrame, then: DataFrame, keys: list[str], first_ts: str, then_ts: str, within: str, delay: str) -> DataFrame:
    """Rows of one stream with those of another, of the same keys, that come at most `within` later; a row that nothing follows comes out alone.

    Two watermarks bound what either side keeps; a row comes out alone when the lower of
    them has passed the time in which anything could follow. The two sides' columns have
    names of their own, but for the keys.
    """
    a = first.withWatermark(first_ts, delay)
    b = then.withWatermark(then_ts, delay).select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in then.columns if c not in keys))
    near = (F.col(then_ts) >= F.col(first_ts)) & (F.col(then_ts) <= F.col(first_ts) + F.expr(f"interval {within}"))
    for k in keys:
        near &= F.col(k) == F.col(f"_{k}")
    return a.join(b, near, "left").drop(*(f"_{k}" for k in keys))
