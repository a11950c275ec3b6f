"""Caches by file state, table functions, sketches, layouts of joins, regression, variants and schema reports."""

import datetime
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import parity
from tillframe.functions import columns as fn
from tillframe.operators import aggregates as ag
from tillframe.operators import quality as dq
from tillframe.operators import relational as rel
from tillframe.plans import registry, tools
from tillframe.plans.cache import FileCache, file_state
from tillframe.sources import files


def test_cache_follows_files(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    cache = FileCache(spark)

    def read(filters=""):
        def build():
            built.append(filters)
            return spark.read.parquet(path).where(filters or "true")

        return cache.get(("t", filters), [path], build)

    spark.range(10).write.parquet(path)
    assert read().count() == 10 and read().count() == 10 and read("id > 5").count() == 4 and built == ["", "id > 5"]
    spark.range(3).write.mode("append").parquet(path)
    assert read().count() == 13 and read("id > 5").count() == 4 and built == ["", "id > 5"] * 2
    spark.range(5).write.mode("overwrite").parquet(path)
    assert read().count() == 5 and cache.hits == 1 and cache.misses == 5 and len(cache.entries) == 2
    cache.invalidate("t")
    assert not cache.entries and read().count() == 5 and built[-1] == "" and len(built) == 6
    cache.clear()


def test_cache_is_bounded_and_drops_the_least_recent(spark, tmp_path):
    for name in "abc":
        spark.range(20_000).select((F.xxhash64("id")).alias("v")).write.parquet(f"{tmp_path}/{name}")
    cache = FileCache(spark, max_bytes=450_000)
    get = lambda name: cache.get((name,), [f"{tmp_path}/{name}"], lambda: spark.read.parquet(f"{tmp_path}/{name}"))
    a = get("a")
    assert a.storageLevel.useMemory and 100_000 < cache.size < 450_000
    get("b"), get("a"), get("c")
    assert set(cache.entries) == {("a",), ("c",)} and cache.size <= cache.max_bytes
    cache.max_bytes = 10
    assert get("b").count() == 20_000 and ("b",) not in cache.entries
    cache.clear()
    assert not a.storageLevel.useMemory


def test_file_state_leaves_markers_out(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/t")
    state = file_state(spark, f"{tmp_path}/t", f"{tmp_path}/none")
    assert [p.endswith(".parquet") for p, _, _ in state] == [True] and all(n > 0 and t > 0 for _, n, t in state)


def test_runs_of_days(spark):
    day = lambda n: None if n is None else datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(60)])) for _ in range(90)] + [("one", 5), ("same", 3), ("same", 3), ("none", None)]
    df = spark.createDataFrame([(k, day(n), 1) for k, n in rows], "k string, d date, first_day int")
    want = Counter()
    for k in {k for k, _ in rows}:
        days, run = sorted(n for q, n in rows if q == k and n is not None), []
        found = []
        for n in days:
            if run and n - run[-1] > 2:
                found.append(run)
                run = []
            run = [*run, n]
        for i, x in enumerate([*found, run] if run else found, 1):
            want[k, i, day(x[0]), day(x[-1]), len(x)] += 1
    out = fn.runs(df, "k", "d", 2)
    assert out.columns == ["k", "run", "first_day", "last_day", "n"] and Counter(map(tuple, out.collect())) == want
    assert fn.runs(df.where("false"), "k", "d", 2).count() == 0
    for bad in (("no", "d", 2), ("k", "k", 2), ("k", "d", -1)):
        with pytest.raises(Exception):  # noqa: B017
            fn.runs(df, *bad).count()


def test_order_runs_of_orders_without_a_date(spark, tmp_path):
    day = "timestamp '2024-01-01' + to_days({})"
    c = duckdb.connect()
    c.execute(f"create table orders as select * from (values (1, {day.format(1)}), (1, null), (1, {day.format(70)}), (1, {day.format(20)}), (1, null), (2, null), (null, {day.format(3)}), (null, null), (3, {day.format(9)})) t(o_custkey, o_orderdate)")
    c.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    parity.same(registry.QUERIES["order_runs"](spark, str(tmp_path)), registry.ORACLE_SQL["order_runs"], c)


def test_calendar_in_a_lateral_join(spark):
    d = datetime.date
    spans = spark.createDataFrame([(1, d(2024, 1, 5), d(2024, 1, 7)), (2, None, d(2024, 1, 1)), (3, d(2024, 1, 2), d(2024, 1, 1))], "id int, a date, b date")
    assert sorted((r.id, r.date.day, r.weekend) for r in fn.calendar_of(spans, "a", "b").collect()) == [(1, 5, False), (1, 6, True), (1, 7, True)]


def test_sketches_unite(spark):
    rows = spark.range(60_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).cast("timestamp_ntz").alias("ts"), (F.col("id") * 7919 % 20_011).alias("user"))
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    spans = spark.createDataFrame([(day(0), day(1)), (day(2), day(9)), (day(0), day(10)), (day(50), day(60)), (day(3), day(3))], "a date, b date")
    got = {(r.a, r.b): r.estimate for r in ag.distinct_in_spans(ag.daily_sketches(rows, "ts", "user"), spans, "a", "b").collect()}
    assert len(got) == 5 and got[day(50), day(60)] == got[day(3), day(3)] == 0
    for a, b in ((0, 1), (2, 9), (0, 10)):
        exact = rows.where((F.col("ts") >= F.lit(day(a))) & (F.col("ts") < F.lit(day(b)))).agg(F.countDistinct("user")).first()[0]
        assert abs(got[day(a), day(b)] - exact) <= 0.02 * exact


def test_bucketed_tables_join_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    a = files.bucketed(spark.range(500).select("id", (F.col("id") % 7).alias("v")), "a", ["id"], 4)
    b = files.bucketed(spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("w")), "b", ["k"], 4)
    joined = a.join(b, F.col("id") == F.col("k"))
    plan = tools.plan_text(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 300
    assert "Exchange" in tools.plan_text(spark.range(5).join(spark.range(5).withColumnRenamed("id", "k"), F.col("id") == F.col("k")))
    assert "Exchange" not in tools.plan_text(a.groupBy("id").count())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_one(spark, how):
    r = random.Random(1)
    a = spark.createDataFrame([(r.choice(["hot"] * 20 + [None] * 6 + list("abcd")), i) for i in range(400)], "k string, v long")
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("z", 5)], "k string, w long")
    got = rel.salted_join(a, b, ["k"], how, salts=5)
    assert got.columns == ["k", "v", "w"] and got.exceptAll(a.join(b, "k", how)).count() == 0 and got.count() == a.join(b, "k", how).count()
    hot = {x.k for x in rel.hot_keys(a, ["k"], 0.05).collect()}
    assert hot == {"hot", None}
    assert rel.salted_join(a.where("v < 0"), b, ["k"], how).count() == 0


def test_regression_equals_least_squares(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2)) * [1, 1e4] + [0, 5e4]
    y = 3 + 2 * x[:, 0] - 0.01 * x[:, 1] + r.normal(size=300)
    rows = [(float(v), *map(float, p)) for v, p in zip(y, x, strict=True)] + [(None, 1.0, 1.0), (1.0, None, 1.0)]
    got = {t.term: t for t in ag.regression(spark.createDataFrame(rows, "y double, a double, b double"), "y", ["a", "b"]).collect()}
    design = np.c_[np.ones(300), x]
    b, rest, *_ = np.linalg.lstsq(design, y, rcond=None)
    e = np.sqrt(rest[0] / 297 * np.diag(np.linalg.inv(design.T @ design)))
    for i, t in enumerate(["constant", "a", "b"]):
        assert np.allclose([got[t].coefficient, got[t].std_error, got[t].t], [b[i], e[i], b[i] / e[i]], rtol=1e-6)
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (2.0, 3.0, 6.0), (3.0, 5.0, 10.0), (9.0, 7.0, 14.0)], "y double, a double, b double")
    with pytest.raises(ValueError, match="depend"):
        ag.regression(df, "y", ["a", "b"])
    with pytest.raises(ValueError, match="fewer"):
        ag.regression(df.limit(1), "y", ["a"])


def test_properties_of_variants(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 2.5, "b": null}', '{"a": "1", "c": [1], "d": {"e": 1}}', "[1]", "7", "{}", None, "broken"]
    df = spark.createDataFrame([(1, t) for t in texts], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    got = {(r.property, r.kind, r.n, r.total) for r in ag.properties(df, "v", ("k",)).collect()}
    assert got == {("a", "number", 2, 3.5), ("a", "string", 1, None), ("b", "string", 1, None), ("b", "void", 1, None), ("c", "array", 1, None), ("d", "object", 1, None)}


def test_schema_report_counts_rows(spark):
    df = spark.createDataFrame([(1, 1.25, "x"), (70000, 1.5, None), (None, None, "y")], "a long, b double, c string").withColumn("e", F.lit(1))
    declared = T.StructType.fromDDL("a smallint, b decimal(9,1), c string not null, d date")
    assert sorted(map(tuple, dq.schema_report(df, declared).collect())) == [("a", "bigint, not smallint", 1), ("b", "double, not decimal(9,1)", 1), ("c", "null", 1), ("d", "missing", 3), ("e", "unexpected", 3)]
    assert dq.schema_report(df, df.schema).count() == 0


def test_narrowest_types(spark):
    df = spark.createDataFrame([(1, -129, 2**40, "x", None)], "a long, b int, c long, d string, e long")
    assert sorted(map(tuple, dq.narrowest(df).collect())) == [("a", "bigint", "tinyint", 7), ("b", "int", "smallint", 2), ("e", "bigint", "tinyint", 7)]
    small, _ = dq.downcast(df)
    assert dict(small.dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "string", "e": "tinyint"} and small.first() == (1, -129, 2**40, "x", None)
    assert dq.narrowest(df.select("d")).count() == 0
