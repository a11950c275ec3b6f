"""Windows and joins along one long order, against Spark's own windows and plain loops, at several numbers of ranges."""

import datetime
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests import parity
from tillframe.operators import ranges
from tillframe.operators import relational as rel
from tillframe.plans import registry, tools

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=[4, 8, 200])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["rolling_50_events", "rolling_hours_by_type", "running_events", "asof_within_minutes", "asof_nearest", "offers_at_order"])
def test_queries_at_any_number_of_ranges(spark, parts, name):
    parity.same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], parity.connect(SF))


def series(spark, n=700, hot=0.9, seed=3):
    """(id, k, t, v): most rows of one key, some times shared, some values null."""
    r = random.Random(seed)
    rows = [(i, "hot" if r.random() < hot else r.choice(["a", "b", "c", None]), r.randrange(2000), None if r.random() < 0.1 else r.uniform(-5, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(5)


def rows(df):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 60])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_rolling_rows_equal_windows(spark, parts, n, keys):
    if parts == 200 and n == 2:
        pytest.skip("as with 8")
    df = series(spark)
    outputs = {"n": F.count("v"), "mean": F.avg("v"), "high": F.max("v"), "first": F.first("id")}
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(-(n - 1), 0)
    want = df.select("*", *(c.over(w).alias(k) for k, c in outputs.items()))
    assert rows(ranges.rolling_rows(df, ["t", "id"], n, outputs, keys)) == rows(want)


def test_a_halo_spans_ranges_smaller_than_the_window(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    df = spark.range(60).select("id", (F.col("id") * 1.0).alias("v"))
    got = ranges.rolling_rows(df, ["id"], 25, {"s": F.sum("v"), "n": F.count("v")}, min_periods=25)
    assert {r.id: (r.s, r.n) for r in got.collect()} == {i: (float(sum(range(i - 24, i + 1))), 25) if i >= 24 else (None, None) for i in range(60)}
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_rolling_spans_equal_windows(spark, parts, keys):
    df = series(spark).withColumn("t", F.when(F.col("id") % 50 != 0, F.col("t")))
    outputs = {"n": F.count(F.lit(1)), "total": F.sum("v"), "low": F.min("v")}
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-150, 0)
    assert rows(ranges.rolling_span(df, "t", 150, outputs, keys)) == rows(df.select("*", *(c.over(w).alias(k) for k, c in outputs.items())))


@pytest.mark.parametrize("keys,span", [((), 150), (("k",), 150), (("k",), 1), (("k",), 5000)])
def test_rolling_moments_equal_windows(spark, parts, keys, span):
    df = series(spark).withColumn("t", F.when(F.col("id") % 50 != 0, F.col("t") - 1000))
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-span, 0)
    outputs = {"n": F.count(F.lit(1)), "total": F.sum("v"), "sd": F.stddev_samp("v")}
    assert rows(ranges.rolling_moments(df, "t", span, "v", keys)) == rows(df.select("*", *(c.over(w).alias(k) for k, c in outputs.items())))


def test_rolling_moments_beside_a_huge_value(spark):
    df = spark.createDataFrame([(i, 1e300 if i == 4 else float("nan") if i == 50 else 1.0 + i % 2) for i in range(100)], "t long, v double")
    got = {r.t: (r.n, r.total, round(r.sd, 6)) for r in ranges.rolling_moments(df, "t", 3, "v").where("t between 8 and 40 or t > 53").collect()}
    assert len(got) == 79 and set(got.values()) == {(4, 6.0, round(math.sqrt(1 / 3), 6))}
    assert ranges.rolling_moments(df.where("false"), "t", 3, "v").count() == 0
    for bad in (("v", 3, "t"), ("t", 0, "v")):
        with pytest.raises(ValueError):
            ranges.rolling_moments(df, *bad)


def test_rolling_hours_go_through_no_frame_anew(spark):
    plan = tools.plan_text(registry.QUERIES["rolling_hours_by_type"](spark, SF))
    assert "RangeFrame, unboundedpreceding$(), currentrow$()" in plan and not re.search(r"RangeFrame, -\d", plan)


def test_rolling_spans_of_times(spark):
    day = datetime.datetime(2024, 3, 1)
    df = spark.createDataFrame([(i, day + datetime.timedelta(minutes=7 * i)) for i in range(100)], "id long, ts timestamp")
    for kind in ("timestamp", "timestamp_ntz"):
        got = ranges.rolling_span(df.withColumn("ts", F.col("ts").cast(kind)), "ts", 3_600_000_000, {"n": F.count(F.lit(1))})
        assert {r.id: r.n for r in got.collect()} == {i: min(i, 8) + 1 for i in range(100)}
    with pytest.raises(ValueError):
        ranges.rolling_span(df.withColumn("ts", F.lit("x")), "ts", 1, {"n": F.count(F.lit(1))})


def test_running_sums_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(i, None if i < 3 else float(i)) for i in range(10)], "id long, v double")
    got = {r.id: (r.running, r.running_total) for r in ranges.running(df, ["id"], F.col("v")).collect()}
    assert got == {i: (None if i < 3 else float(sum(range(3, i + 1))), 42.0) for i in range(10)}
    nothing = df.where("id < 0")
    assert ranges.running(nothing, ["id"]).count() == 0 and ranges.rolling_rows(nothing, ["id"], 5, {"n": F.count("v")}).count() == 0
    assert ranges.rolling_span(nothing, "id", 5, {"n": F.count("v")}).count() == 0


def test_a_hot_key_is_many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    df = series(spark, 8000)
    tasks = ranges.together(ranges.ranged(df, ["k", "t", "id"])).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 15 and max(r["count"] for r in tasks) < 2 * 8000 / 20
    plan = tools.plan_text(ranges.rolling_rows(df, ["t", "id"], 50, {"n": F.count("v")}))
    assert "SinglePartition" not in plan and "hashpartitioning" not in plan and "shufflepartitionidpassthrough" in plan
    spark.conf.set("spark.sql.shuffle.partitions", before)


# ---------------------------------------------------------------- as-of


def plain_asof(left, right, direction, tolerance):
    out = []
    for i, k, t in left:
        best = None
        if k is not None and t is not None:
            same = [r for r in right if r[0] == k and r[1] is not None]
            back = max((r for r in same if r[1] <= t), key=lambda r: (r[1], r[2]), default=None)
            inclusive = direction == "forward"
            ahead = min((r for r in same if r[1] > t or inclusive and r[1] == t), key=lambda r: (r[1], r[2]), default=None)
            if direction == "backward":
                best = back
            elif direction == "forward":
                best = ahead
            else:
                best = back if ahead is None or back is not None and t - back[1] <= ahead[1] - t else ahead
            if best and tolerance is not None and abs(best[1] - t) > tolerance:
                best = None
        out.append((i, k, t, best[2] if best else None))
    return Counter(out)


@pytest.mark.parametrize("direction,tolerance", [("backward", None), ("backward", 15), ("forward", None), ("nearest", None), ("nearest", 4)])
def test_asof_equals_plain_search(spark, parts, direction, tolerance):
    r = random.Random(5)
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
    left = [(i, key(), r.choice([None, r.randrange(3000)])) for i in range(400)] + [(i, "hot", 777) for i in range(1000, 1040)] + [(7, "only", 5)] * 3
    right = [(key(), r.choice([None, r.randrange(3000), r.randrange(3000), 777]), i) for i in range(150)]
    a = spark.createDataFrame(left, "id long, k string, t long").repartition(3)
    b = spark.createDataFrame(right, "k string, at long, v long").repartition(2)
    got = ranges.asof(a, b, ["k"], "t", "at", ["v"], direction, tolerance)
    assert got.columns == ["id", "k", "t", "v"] and Counter(tuple(x) for x in got.collect()) == plain_asof(left, right, direction, tolerance)


def test_asof_without_rows_and_with_clashes(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id long, k string, _v long")
    b = spark.createDataFrame([("x", 5, 9)], "k string, at long, v long")
    assert rel.nearest_before(a, b.where("v < 0"), ["k"], "_v", "at", ["v"]).first().v is None
    assert rel.nearest_before(a.where("id < 0"), b, ["k"], "_v", "at", ["v"]).count() == 0
    assert ranges.asof(a, b, ["k"], "_v", "at", ["v"]).first().asDict() == {"id": 1, "k": "x", "_v": 5, "v": 9}
    assert ranges.asof(a, b, [], "_v", "at", ["v"]).first().v == 9
    with pytest.raises(ValueError):
        ranges.asof(a, b.withColumnRenamed("v", "id"), ["k"], "_v", "at", ["id"])


# ---------------------------------------------------------------- intervals


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_equal_plain_search(spark, few, keys, how):
    r = random.Random(8)
    left = [(i, r.choice(["a", "b", None]), r.choice([None, 0.0, r.uniform(-100, 100), float(r.randrange(-50, 50))])) for i in range(200)]
    right = []
    for j in range(90):
        low = r.choice([r.uniform(-100, 100), float(r.randrange(-50, 50))])
        right.append((r.choice(["a", "b", None]), j, low, r.choice([low, low - 1, low + 1, low + r.uniform(0, 0.001), low + 500, low + 1e-9, None])))
    a = spark.createDataFrame(left, "id long, k string, x double").repartition(3)
    b = spark.createDataFrame(right, "k string, j long, low double, high double")
    b = b if keys else b.drop("k")
    got = Counter((x.id, x.j) for x in ranges.interval_join(a, b, "x", "low", "high", keys, how, few).collect())
    want = Counter()
    for i, k, x in left:
        hits = [j for q, j, low, high in right if x is not None and high is not None and low <= x < high and (not keys or k is not None and k == q)]
        want.update((i, j) for j in hits)
        want.update([(i, None)] if how == "left" and not hits else [])
    assert got == want


def test_many_intervals_need_no_nested_loop(spark):
    a = spark.range(5000).select("id", (F.col("id") % 977).cast("double").alias("x"))
    b = spark.range(3000).select(F.col("id").alias("j"), (F.col("id") % 900).cast("double").alias("low"), (F.col("id") % 900 + F.pow(F.lit(2.0), F.col("id") % 9)).alias("high"))
    plan = tools.plan_text(joined := ranges.interval_join(a, b, "x", "low", "high"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = a.join(b, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).groupBy("id").count()
    assert rows(joined.groupBy("id").count()) == rows(want)
    assert "BroadcastNestedLoopJoin" in tools.plan_text(ranges.interval_join(a, b.limit(10), "x", "low", "high"))
    assert ranges.interval_join(a, b.where("j < 0"), "x", "low", "high", how="left", few=0).where("j is null").count() == 5000
    with pytest.raises(ValueError):
        ranges.interval_join(a, b.withColumnRenamed("j", "id"), "x", "low", "high")


def test_offers_at_order_joins_no_more_than_moments_and_spans(spark, tmp_path, monkeypatch):
    c = duckdb.connect()
    c.execute(f"copy (select o_orderkey + k * 15000 as o_orderkey, o_custkey, case when o_orderkey % 99 > 0 then o_orderdate end as o_orderdate from '{SF}/orders.parquet', range(3) r(k)) to '{tmp_path}/orders.parquet'")
    c.execute(f"copy (select p_partkey + k * 2000 as p_partkey, p_size, p_retailprice from '{SF}/part.parquet', range(20) r(k)) to '{tmp_path}/part.parquet'")
    for t in ("orders", "part"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    joined, join = [], ranges.interval_join
    monkeypatch.setattr(ranges, "interval_join", lambda *a, **b: joined.append(join(*a, **b)) or joined[-1])
    parity.same(registry.QUERIES["offers_at_order"](spark, str(tmp_path)), registry.ORACLE_SQL["offers_at_order"], c)
    moments = c.sql("select count(distinct o_orderdate) from orders").fetchall()[0][0]
    assert joined[0].count() <= 36 * moments
