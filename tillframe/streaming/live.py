"""The live feed: a simulated point of sale, its buffer, and incremental KPIs.

Streaming and batch are separate packages that share transformations: live_kpis() is the
same aggregation whether its input is a stream or a table. On a stream Spark keeps its
state between batches, so no tick repeats the history. This simulates a feed; production
would read a message log with offsets, and emit from real tills.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from .state import activity

FEED_SCHEMA = "event_id long, ts timestamp, customer_id long, product_id long, qty int, amount double"


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.rate, self.start, self.seed = int(options.get("rowspertick", 5)), int(options.get("startepoch", 1_700_000_000)), int(options.get("seed", 42))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def row(self, n: int) -> tuple:
        import datetime
        import random

        r = random.Random(self.seed * 1_000_003 + n)
        qty = r.randint(1, 5)
        return n, datetime.datetime.fromtimestamp(self.start + n, datetime.timezone.utc), r.randint(1, 1000), int(r.paretovariate(1.2)), qty, round(qty * r.uniform(1, 50), 2)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start["n"] + self.rate
        return iter([self.row(n) for n in range(start["n"], end)]), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.row(n) for n in range(start["n"], end["n"])])


class PosFeed(DataSource):
    """Seeded sales events, rowsPerTick of them for each micro-batch; replays alike after a failure."""

    @classmethod
    def name(cls) -> str:
        return "pos_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def start_feed(spark: SparkSession, rows_per_tick: int = 5, seed: int = 42) -> DataFrame:
    spark.dataSource.register(PosFeed)
    return spark.readStream.format("pos_feed").option("rowsPerTick", rows_per_tick).option("seed", seed).load()


def start_buffer(stream: DataFrame, path: str, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Append the feed to a table of files; exactly once, by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that the source holds now, append closed results to a table of files, and stop; a later run goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def updates_to(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream in update mode: each batch's updates become files under its number, so a batch that is repeated replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that the source holds now; the updates of all runs so far, each with its batch."""
    updates_to(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return updates(stream, path)


def updates(stream: DataFrame, path: str) -> DataFrame:
    """What updates_to() has written of a stream, with the number of each batch."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.sparkSession.read.schema(f"{columns}, batch long").parquet(path)


def latest(found: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    columns = [c for c in found.columns if c not in (*keys, "batch")]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_last")).select(*keys, "_last.*")


def latest_by_key(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """The last update of each key of a stream in update mode, at the end of what its source holds now."""
    return latest(run_updates(stream, path, checkpoint), keys)


def tumbling(df: DataFrame, ts: str, width: str, delay: str | None = None, keys: tuple[str, ...] = (), **outputs) -> DataFrame:
    df = df.withWatermark(ts, delay) if delay and df.isStreaming else df
    return df.groupBy(F.window(ts, width), *keys).agg(*(c.alias(k) for k, c in outputs.items()))


def sliding(df: DataFrame, ts: str, width: str, step: str, delay: str | None = None, keys: tuple[str, ...] = (), **outputs) -> DataFrame:
    df = df.withWatermark(ts, delay) if delay and df.isStreaming else df
    return df.groupBy(F.window(ts, width, step), *keys).agg(*(c.alias(k) for k, c in outputs.items()))


def session(df: DataFrame, ts: str, gap: str, keys: tuple[str, ...], delay: str | None = None, **outputs) -> DataFrame:
    df = df.withWatermark(ts, delay) if delay and df.isStreaming else df
    return df.groupBy(F.session_window(ts, gap), *keys).agg(*(c.alias(k) for k, c in outputs.items()))


def live_kpis(df: DataFrame, ts: str = "ts", width: str = "1 minute", amount: str = "amount", delay: str | None = "10 minutes") -> DataFrame:
    """Sales, revenue and average sale by time window; batch and stream alike."""
    out = tumbling(df, ts, width, delay, n=F.count(F.lit(1)), revenue=F.sum(amount))
    return out.select(F.col("window.start").alias("start"), "n", "revenue", F.try_divide("revenue", "n").alias("average"))


def start_live_panel(stream: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", width: str = "1 minute") -> StreamingQuery:
    """The panel's table, kept up to date at the given interval: open windows are updated, and read by live_panel()."""
    return updates_to(live_kpis(stream, width=width), path, checkpoint).trigger(processingTime=every).start()


def live_panel(stream: DataFrame, path: str, width: str = "1 minute") -> DataFrame:
    """The panel as it stands: each window once, by its last update."""
    return latest(updates(live_kpis(stream, width=width), path), ["start"])


def dedup_stream(df: DataFrame, ids: list[str], ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)


def stateful_totals(stream: DataFrame, key: str, ts: str, amount: str, salts: int = 8) -> DataFrame:
    """Running totals by key, kept in state of their own; a key's rows are dealt over salts, whose totals are to be added up."""
    salt = F.pmod(F.xxhash64(*stream.columns), F.lit(salts))
    kept = activity(stream, {key: F.col(key), "salt": salt}, ts, F.col(amount), F.lit("row"))
    return kept.select(key, "salt", "n", "total")
