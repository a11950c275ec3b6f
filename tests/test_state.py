"""State of their own, joins and panels of streams, delivered in files one after the other."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tillframe.streaming import live, state

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(hours: float) -> datetime.datetime:
    return START + datetime.timedelta(hours=hours)


class Feed:
    """A stream of files, and what a query over it has written so far."""

    def __init__(self, spark, folder, schema: str, query, append: bool = False):
        self.spark, self.folder, self.schema, self.query, self.append = spark, folder, schema, query, append

    def deliver(self, rows):
        path = f"{self.folder}/in"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(path)
        stream = self.spark.readStream.schema(self.schema).parquet(path)
        with state.rocksdb(self.spark):
            return live.run_updates(self.query(stream), f"{self.folder}/out", f"{self.folder}/check")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_totals_kinds_and_last_amounts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, ts timestamp, v double, kind string", lambda s: state.activity(s, {"k": F.col("k")}, "ts", F.col("v"), F.col("kind"), None))
    feed.deliver([("a", at(1), 1.0, "x"), ("a", at(3), 3.0, "y"), ("b", at(2), None, "x"), ("a", None, 100.0, "x"), (None, at(1), 7.0, None)])
    rows = feed.deliver([("a", at(2), 2.0, "x"), ("a", at(9), 9.0, "x")])
    last = {r.k: r for r in live.latest(rows, ["k"]).collect()}
    a = last["a"]
    assert (a.n, a.total, a.kinds, a.recent, a.last_us) == (4, 15.0, {"x": 3, "y": 1}, [2.0, 3.0, 9.0], int(at(9).timestamp() * 1e6))
    assert (last["b"].n, last["b"].total) == (1, 0.0) and last[None].n == 1 and rows.count() == 4


def test_an_alert_when_the_timer_expires(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, ts timestamp, v double", lambda s: state.activity(s, {"k": F.col("k")}, "ts", F.col("v"), F.lit("row"), 6 * 3_600_000, "1 hour"))
    alerts = lambda rows: sorted((r.k, r.n) for r in rows.where("what = 'inactive'").collect())
    assert alerts(feed.deliver([("a", at(0), 1.0), ("b", at(4), 1.0)])) == []  # the watermark is at 3
    assert alerts(feed.deliver([("b", at(7.5), 1.0)])) == [("a", 1)]  # at 6.5, over 0 + 6
    assert alerts(feed.deliver([("a", at(8), 1.0), ("b", at(10), 1.0)])) == [("a", 1)]  # a is back, with a new timer
    assert alerts(feed.deliver([("c", at(30), 1.0)])) == [("a", 1), ("a", 2), ("b", 3)]


def test_salted_totals_and_the_sessions_provider(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    feed = Feed(spark, tmp_path, "k string, ts timestamp, v double", lambda s: live.stateful_totals(s, "k", "ts", "v", 4))
    rows = feed.deliver([("hot", at(k / 60), 1.0) for k in range(40)] + [("b", at(1), 5.0)])
    salts = live.latest(rows, ["k", "salt"])
    assert salts.where("k = 'hot'").count() == 4
    assert {(r.k, r.n, r.t) for r in salts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect()} == {("hot", 40, 40.0), ("b", 1, 5.0)}
    assert spark.conf.get(key, None) == before


class Kept:
    """A state of one key that counts the calls it gets, as each goes from the worker to the executor and back."""

    def __init__(self):
        self.value, self.map, self.list, self.calls = None, {}, [], []

    def __getattr__(self, name):
        return lambda *a: self.calls.append(name) or {"get": lambda: self.list or self.value, "update": lambda v: setattr(self, "value", v), "put": lambda v: setattr(self, "list", v),
            "iterator": lambda: iter(self.map.items()), "updateValue": self.map.__setitem__, "registerTimer": lambda t: None, "deleteTimer": lambda t: None}[name](*a)


def test_a_key_reads_what_is_kept_once():
    activity = state.Activity(1, 1000)
    activity.handle, activity.totals, activity.kinds, activity.recent = (Kept() for _ in range(4))
    activity.recent.get = lambda: activity.recent.calls.append("get") or iter(activity.recent.list)
    row = Row("us", "amount", "kind")
    states = (activity.totals, activity.kinds, activity.recent, activity.handle)
    (first,) = activity.handleInputRows(("a",), iter([row(5000, 1.0, "x"), row(1000, None, "y"), row(None, 9.0, "x"), row(3000, 2.0, "x"), row(2000, 4.0, None)]), None)
    assert (first.n, first.total, first.last_us, first.kinds, first.recent) == (4, 7.0, 5000, {"x": 2, "y": 1}, [4.0, 2.0, 1.0])
    assert [x.calls for x in states] == [["get", "update"], ["updateValue"] * 2, ["put"], ["registerTimer"]]
    for x in states:
        x.calls.clear()
    (then,) = activity.handleInputRows(("a",), iter([row(4000, 8.0, "y")]), None)
    assert (then.n, then.total, then.last_us, then.kinds, then.recent) == (5, 15.0, 5000, {"x": 2, "y": 2}, [2.0, 8.0, 1.0])
    assert [x.calls for x in states] == [["get", "update"], ["iterator", "updateValue"], ["get", "put"], []]


def test_follow_ups_come_once_and_late(spark, tmp_path):
    views, bought = "k string, ts timestamp, id long", "k string, bought timestamp, pid long"
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"

    def deliver(a, b):
        spark.createDataFrame(a, views).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        spark.createDataFrame(b, bought).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        x, y = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for s, n in ((views, "a"), (bought, "b")))
        with state.rocksdb(spark):
            live.run_to_end(state.follow_ups(x, y, ["k"], "ts", "bought", "2 hours", "1 hour"), out, check)
        return sorted(((r.id, r.pid) for r in spark.read.parquet(out).collect()), key=str)

    assert deliver([("a", at(0), 1), ("b", at(0), 2), ("a", at(4), 3)], [("a", at(1), 10), ("a", at(2), 11), ("b", at(3), 12)]) == [(1, 10), (1, 11)]
    # the lower watermark is at 9 now: 2 and 3 found nothing within two hours, 4 may still
    assert deliver([("a", at(10), 4)], [("a", at(7), 13), ("b", at(10), 14)]) == [(1, 10), (1, 11), (2, None), (3, None)]
    assert deliver([("c", at(11), 5)], [("a", at(11), 15)]) == [(1, 10), (1, 11), (2, None), (3, None), (4, 15)]


def test_a_panel_shows_each_window_by_its_last_update(spark, tmp_path):
    schema = "ts timestamp, amount double"
    for rows in ([(at(0), 1.0), (at(0.1), 2.0)], [(at(0.05), 3.0), (at(1), 5.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = live.start_live_panel(stream, f"{tmp_path}/out", f"{tmp_path}/check", "0 seconds", "1 hour")
        q.processAllAvailable()
        q.stop()
    got = {(r.n, r.revenue, r.average) for r in live.live_panel(stream, f"{tmp_path}/out", "1 hour").collect()}
    assert got == {(3, 6.0, 2.0), (1, 5.0, 5.0)}
