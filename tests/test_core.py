import datetime
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tests import parity
from tillframe import schemas
from tillframe.functions import columns as fn
from tillframe.operators import aggregates as ag
from tillframe.operators import quality as dq
from tillframe.operators import relational as rel
from tillframe.operators import segments as sg
from tillframe.operators import timeseries as ts
from tillframe.plans import pages, registry, tools
from tillframe.sources import files, generator
from tillframe.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    parity.same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---------------------------------------------------------------- hand-calculated figures

SALES = [
    (1, "c1", "North", "2023-01-15", "p1", "A", 2, 10.0, 0.00, 6.0),
    (2, "c2", "North", "2023-01-20", "p2", "A", 1, 20.0, 0.10, 15.0),
    (3, "c3", "South", "2023-03-05", "p3", "B", 4, 5.0, 0.00, 2.0),
    (4, "c1", "North", "2024-01-10", "p2", "A", 2, 20.0, 0.00, 15.0),
    (5, "c1", "North", "2024-03-01", "p1", "A", 1, 10.0, 0.20, 6.0),
    (6, "c3", "South", "2024-03-09", "p3", "B", 10, 5.0, 0.00, 2.0),
]


@pytest.fixture(scope="module")
def sales(spark):
    df = spark.createDataFrame(SALES, "order_id int, customer string, region string, d string, product string, category string, qty int, price double, discount double, cost double")
    return df.select("*", F.col("d").cast("timestamp_ntz").alias("ts"), (F.col("qty") * F.col("price") * (1 - F.col("discount"))).alias("rev"), (F.col("qty") * F.col("cost")).alias("total_cost"))


def test_margin(sales):
    r = ag.kpi_margin(sales, [], "rev", "total_cost").first()
    assert (r.revenue, r.cost, r.profit, round(r.margin, 6)) == (156, 91, 65, 0.416667)


def test_exec_kpis(sales):
    r = ag.exec_kpis(sales, "order_id", "customer", "rev", "qty").first()
    assert (r.revenue, r.orders, r.aov, r.active_customers, round(r.repeat_rate, 6)) == (156, 6, 26, 3, 0.666667)


def test_yoy(sales):
    years = sales.groupBy(F.year("ts").alias("y")).agg(F.sum("rev").alias("r"))
    assert [(r.r, r.growth and round(r.growth, 6)) for r in ts.period_delta(years, "y", "r").orderBy("y").collect()] == [(58, None), (98, 0.689655)]


def test_resample_fills_gaps_and_averages(sales):
    months = ts.resample(sales.where("ts < '2024-01-01'"), "ts", "month", {"rev": F.sum("rev")}, fill={"rev": 0.0})
    rows = ts.rolling(months, "period", "rev", 3).orderBy("period").collect()
    assert [r.rev for r in rows] == [38, 0, 20]
    assert [r.rolling and round(r.rolling, 6) for r in rows] == [None, None, 19.333333]


def test_pareto_and_abc(sales):
    rows = {r["product"]: r for r in sg.abc(sales, "product", "rev").collect()}
    assert {k: (r.total, round(r.cum_share, 6), r["class"]) for k, r in rows.items()} == {"p3": (70, 0.448718, "A"), "p2": (58, 0.820513, "B"), "p1": (28, 1.0, "C")}


def test_rfm(sales):
    rows = {r.customer: (r.recency, r.frequency, r.monetary) for r in sg.rfm(sales, "customer", "ts", "rev", "2024-03-31").collect()}
    assert rows == {"c1": (30, 3, 68), "c2": (436, 1, 18), "c3": (22, 2, 70)}


def test_cohorts(sales):
    got = {(str(r.cohort)[:7], r.k): r.customers for r in sg.cohorts(sales, "customer", "ts").collect()}
    assert got == {("2023-01", 0): 2, ("2023-01", 12): 1, ("2023-01", 14): 1, ("2023-03", 0): 1, ("2023-03", 12): 1}


def test_pivot_leaves_empty_cells(sales):
    rows = {r.region: (r.A, r.B) for r in ag.pivot(sales, ["region"], "category", ["A", "B"], {"v": F.sum("rev")}).collect()}
    assert rows == {"North": (86, None), "South": (None, 70)}


def test_inactive_customers(spark, sales):
    all_ = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "customer string")
    assert [r.customer for r in rel.without_match(all_, sales, "customer", "customer").collect()] == ["c4"]


# ---------------------------------------------------------------- sources and quality


def test_malformed_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v,ts\n1,2.5,2024-01-01 00:00:00\nx,3,2024-01-02 00:00:00\n3,4\n4,5,2024-01-01 00:00:00,zz\n")
    good, bad = files.load_csv(spark, str(tmp_path / "x.csv"), T.StructType.fromDDL("id int, v double, ts timestamp_ntz"))
    assert [r.id for r in good.collect()] == [1]
    assert sorted(r[files.CORRUPT] for r in bad.collect()) == ["3,4", "4,5,2024-01-01 00:00:00,zz", "x,3,2024-01-02 00:00:00"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "n int, s string")
    files.export_csv(df, str(tmp_path / "csv"))
    files.export_xlsx(df, str(tmp_path / "r.xlsx"))
    files.export_pdf(df, str(tmp_path / "r.pdf"), "Report (1)")
    files.write_processed(df, str(tmp_path / "p"), ("n",))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert b"a&lt;b" in zipfile.ZipFile(tmp_path / "r.xlsx").read("xl/worksheets/sheet1.xml")
    assert (tmp_path / "r.pdf").read_bytes().startswith(b"%PDF") and len(list((tmp_path / "csv").glob("*.csv"))) == 1
    files.export_csv(df.repartition(2), str(tmp_path / "large"), one_file=1)  # too many rows for one file
    assert len(list((tmp_path / "large").glob("*.csv"))) == 2 and spark.read.csv(str(tmp_path / "large"), header=True).count() == 2
    with pytest.raises(ValueError):
        files.export_xlsx(df, str(tmp_path / "no.xlsx"), cap=1)


@pytest.mark.parametrize("n", [2, 7])
def test_generator_is_reproducible(spark, n):
    a = generator.generate(spark, 300, seed=1)
    for name in ("orders", "returns", "shipping"):
        one, other = a[name], generator.generate(spark, 300, seed=1)[name].repartition(n)
        assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0
    assert a["orders"].exceptAll(generator.generate(spark, 300, seed=2)["orders"]).count() > 0
    assert a["orders"].count() == 300
    for name, df in a.items():
        assert dq.validate_schema(df, schemas.TABLES[name]) == [], name
    assert rel.fk_violations(a["orders"], a["customers"], "customer_id", "customer_id").count() == 0


def test_generator_is_skewed(spark):
    t = generator.generate(spark, 3000)
    lines = ag.explode_items(t["orders"])
    top = sg.pareto(lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")), "product_id", "n").where("cum_share <= 0.5").count()
    assert top < 0.25 * t["products"].count()


def test_null_strategies_know_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 4.0, "x"), (3, 8.0, "x"), (None, 1.0, "y")], "id int, v double, s string")
    out = dq.handle_nulls(df, {"id": dq.Drop(), "v": dq.Impute("mean"), "s": dq.Flag()}).orderBy("id").collect()
    assert [(r.id, r.v, r.s_missing) for r in out] == [(1, 6.0, True), (2, 4.0, False), (3, 8.0, False)]


def test_rules_and_reasons(spark):
    df = spark.createDataFrame([(1, 2), (-1, 2), (None, -5)], "a int, b int")
    ok, bad = dq.validate_rows(df, {"a": F.col("a") > 0, "b": F.col("b") > 0})
    assert ok.count() == 1 and sorted(len(r.reasons) for r in bad.collect()) == [1, 2]


def test_dedup_and_downcast(spark):
    df = spark.createDataFrame([(1, 5, 300), (1, 4, 70000), (2, 9, 1)], "k long, v long, w long")
    assert sorted((r.k, r.v) for r in ag.dedup(df, ["k"], [F.asc("v")]).collect()) == [(1, 4), (2, 9)]
    small, report = dq.downcast(df)
    assert dict(small.dtypes) == {"k": "tinyint", "v": "tinyint", "w": "int"} and report.count() == 3


def test_observed_counts(spark):
    df, seen = dq.logged(spark.range(10), "stage", F.col("id") < 7)
    df.count()
    assert seen.get == {"rows": 10, "accepted": 7, "rejected": 3}
    dq.report("stage", seen)


def test_null_keys_in_merge(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string"), spark.createDataFrame([(None, 5)], "k int, b int")
    assert rel.merge(a, b, "k").count() == 0 and rel.merge(a, b, "k", null_equal=True).count() == 1


def test_empty_inputs(spark, sales):
    none = sales.where("false")
    assert sg.pareto(none, "product", "rev").count() == 0 and sg.cohorts(none, "customer", "ts").count() == 0
    assert ts.resample(none, "ts", "day", {"v": F.sum("rev")}).count() == 0 and sg.outliers_iqr(none, "rev").count() == 0


def test_holt(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 5, 9, 8])], "t int, v double")
    level, trend = 3.0, 2.0
    for x in (5, 9, 8):
        new = 0.5 * x + 0.5 * (level + trend)
        level, trend = new, 0.3 * (new - level) + 0.7 * trend
    assert [round(r.forecast, 9) for r in ts.holt(df, "t", "v", 0.5, 0.3, 2).orderBy("step").collect()] == [round(level + trend, 9), round(level + 2 * trend, 9)]


def test_ntiles_match_spark(spark):
    from pyspark.sql import Window

    df = spark.range(23).withColumn("v", (F.col("id") * 7) % 10)
    want = df.withColumn("b", F.ntile(5).over(Window.orderBy("v", "id")).cast("long"))
    assert sg.ntiles(df, [F.asc("v"), F.asc("id")], 5, "b").exceptAll(want).count() == 0


def test_row_numbers_beyond_the_sample_of_bounds(spark):
    """Far more rows than range bounds are drawn from, with columns beside the order's."""
    n = 400_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n).alias("v"), F.col("id").alias("a"), F.xxhash64("id").alias("b"))
    ranked = sg.running_over_all(df, [F.asc("v")], None, "i")
    wrong = F.sum(F.when(F.col("i") != F.col("v") + 1, 1).otherwise(0))
    assert ranked.agg(F.count("b"), wrong, F.sum("a"), F.min("i_total"), F.max("i_total")).first() == (n, 0, n * (n - 1) // 2, n, n)


@pytest.mark.parametrize("sf,partitions", [("sf0.01", 4), ("sf0.01", 8), ("sf0.01", 200), ("sf0.1", 4), ("sf0.1", 200)])
def test_ranks_at_any_number_of_partitions(spark, sf, partitions):
    before, folder = spark.conf.get("spark.sql.shuffle.partitions"), f"/root/testdata/{sf}"
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for name in ("rfm_cells", "pareto_products", "abc_products", "encode_categories"):
            parity.same(registry.QUERIES[name](spark, folder), registry.ORACLE_SQL[name], parity.connect(folder))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_and_ranks_match_spark(spark):
    """Nulls, ties, a value that half of the rows have, a group of one row and one of nulls alone."""
    from pyspark.sql import Window

    df = spark.range(0, 5000, 1, 6).select(F.col("id"), F.when(F.col("id") % 7 != 0, (F.col("id") % 4).cast("int")).alias("k"), F.when(F.col("id") % 2 == 0, 3.5).when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(900)) / 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([(-1, 8, 2.0), (-2, 9, None)], "id long, k int, v double"))
    shares = {"a": 0.1, "m": 0.5, "z": 1.0}
    want = df.where("v is not null").groupBy("k").agg(*(F.round(F.percentile("v", F.lit(q)), 9).alias(n) for n, q in shares.items()))
    got = sg.quantiles(df, "v", shares, ("k",)).select("k", *(F.round(n, 9).alias(n) for n in shares))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert round(sg.quantiles(df, "v", {"m": 0.3}).first().m, 9) == round(df.agg(F.percentile("v", F.lit(0.3))).first()[0], 9)
    w = Window.partitionBy("k").orderBy("v")
    want = df.withColumn("pct_rank", F.percent_rank().over(w)).withColumn("cume_dist", F.cume_dist().over(w))
    assert sg.pct_rank(df, "v", ["k"]).exceptAll(want).count() == 0 and sg.pct_rank(df, "v", ["k"]).count() == 5002


def test_generated_margin_equals_sql_over_its_tables(spark, tmp_path):
    import duckdb

    made = generator.generate(spark, 5000)
    for name in ("orders", "products"):
        made[name].write.parquet(str(tmp_path / name))
    sql = f"""with l as (select unnest(items) i from '{tmp_path}/orders/*.parquet' where status = 'complete'),
    r as (select category_id, i.qty * i.unit_price::double * (1 - i.discount) revenue, i.qty * unit_cost::double as cost from l join '{tmp_path}/products/*.parquet' on i.product_id = product_id)
    select category_id, round(sum(revenue), 4), round(sum(cost), 4), round(1 - sum(cost) / sum(revenue), 9) from r group by 1 order by 1"""
    lines = ag.explode_items(made["orders"].where("status = 'complete'")).withColumn("revenue", F.col("qty") * F.col("unit_price").cast("double") * (1 - F.col("discount")))
    joined = lines.join(made["products"].select("product_id", "category_id", "unit_cost"), "product_id").withColumn("cost", F.col("qty") * F.col("unit_cost").cast("double"))
    got = ag.kpi_margin(joined, ["category_id"], "revenue", "cost").orderBy("category_id").select("category_id", F.round("revenue", 4), F.round("cost", 4), F.round("margin", 9)).collect()
    assert [tuple(r) for r in got] == duckdb.sql(sql).fetchall()


def test_stored_bytes_shrink_with_narrower_types(spark):
    df = spark.range(0, 20000, 1, 1).select((F.xxhash64("id") % 100).alias("v"), F.col("id").cast("string").alias("s"))
    assert 0 < dq.stored_bytes(df.select("v")) < dq.stored_bytes(df)


def test_some_streamed_rows_come_too_late(duck):
    late, closed = "event_id % 10 <> 0 or day + interval 1 day > w1.w", "day + interval 1 day <= w2.w"
    sql = registry.ORACLE_SQL["stream_late_rows"]
    count = lambda q: duck.sql(f"select coalesce(sum(n), 0) from ({q})").fetchall()[0][0]
    assert 0 < count(sql) < count(sql.replace(late, "true")) < count(sql.replace(late, "true").replace(closed, "true"))


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Unset:
        def isDefined(self):  # noqa: N802
            return False

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("Sc", (), {"getCheckpointDir": lambda self: Unset()})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(Session())


def test_discarded_tables_are_gone(spark):
    one = files.written(spark.range(3), "one")
    assert one.count() == 3
    files.discard(one)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(one._written_to)


# ---------------------------------------------------------------- plans


def test_a_workspace_leaves_nothing(spark):
    from pathlib import Path

    folder = Path(files.shared_folder(spark))
    before = set(folder.iterdir())
    with files.workspace(spark):
        registry.QUERIES["rfm_cells"](spark, SF).count()
        with files.workspace(spark):
            inner = files.written(spark.range(3), "inner")
        assert len(set(folder.iterdir()) - before) >= 3 and not Path(inner._written_to).exists()
    assert set(folder.iterdir()) == before


def test_filters_and_columns_reach_the_scan(spark):
    text = tools.plan_text(registry.QUERIES["sidebar_filters"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in text and "o_custkey" not in text.split("ReadSchema")[1].split("\n")[0]


def test_dimensions_are_broadcast(spark):
    assert "BroadcastHashJoin" in tools.plan_text(registry.QUERIES["revenue_by_region_month"](spark, SF))


def test_tools(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("shuffle_partitions: 4\n")
    s = tools.Settings.load(str(tmp_path / "s.yaml"), {"TILLFRAME_ABC_A": "0.7"})
    s.apply(spark)
    assert (s.shuffle_partitions, s.abc_a) == (4, 0.7)
    assert tools.bench(spark, {"count": {"spark": lambda: spark.range(10)}}, runs=1).count() == 1
    df = spark.range(3)
    assert tools.chart_spec(df, "id", "id", "How many?")["question"]
    with pytest.raises(ValueError):
        tools.chart_spec(df, "id", "no", "How many?")


def test_measurements_have_time_and_memory(spark):
    from tillframe.plans import measurements

    rows = tools.bench(spark, {k: v for k, v in measurements.cases(spark, SF).items() if k in ("filter", "if/else")}, runs=1, warmup=0).collect()
    assert {r.engine for r in rows} == {"spark", "pandas", "numpy", "spark, Python UDF"} and all(r.median_s > 0 and r.jvm_mb > 0 for r in rows)
    assert measurements.savings(spark, SF).where("what like 'pandas%' and bytes_after < bytes_before").count() == 1


def test_pages(spark):
    t = {n: files.table(spark, SF, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part", "events")}
    for name, page in pages.PAGES.items():
        for part, spec in page(t).items():
            assert spec["question"] and spec["data"].limit(1).count() <= 1, (name, part)


def test_helpers(spark):
    df = spark.createDataFrame([("  a  b ", 5.0, [1.0, 2.0], [3.0, 4.0])], "s string, v double, x array<double>, y array<double>")
    r = df.select(fn.clean_text(F.col("s")).alias("s"), fn.bands(F.col("v"), [1, 9], ["low", "middle", "high"]).alias("b"), fn.dot(F.col("x"), F.col("y")).alias("d"), fn.safe_ratio(F.col("v"), F.lit(0)).alias("z")).first()
    assert tuple(r) == ("a b", "middle", 11.0, None)
    assert fn.calendar(datetime.date(2024, 1, 5), datetime.date(2024, 1, 7)).where("weekend").count() == 2


# ---------------------------------------------------------------- streaming


def test_stream_equals_batch(spark, tmp_path):
    events = files.table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"))
    path = str(tmp_path / "feed")
    for k in range(3):  # one file at a time, in order of time
        events.where(F.pmod(F.dayofmonth("ts"), F.lit(30)).between(k * 10, k * 10 + 9)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = live.live_kpis(stream, width="1 day", delay=None).writeStream.outputMode("complete").format("memory").queryName("kpis").start()
    q.processAllAvailable()
    q.stop()
    batch = live.live_kpis(events, width="1 day")
    got = {(str(r.start), r.n, round(r.revenue, 6)) for r in spark.table("kpis").collect()}
    assert got == {(str(r.start), r.n, round(r.revenue, 6)) for r in batch.collect()}


def test_feed_and_buffer(spark, tmp_path):
    q = live.start_buffer(live.start_feed(spark, 5), str(tmp_path / "buffer"), str(tmp_path / "check"), "0 seconds")
    for _ in range(60):
        q.awaitTermination(1)
        if q.lastProgress and q.lastProgress["batchId"] >= 2:
            break
    q.stop()
    rows = spark.read.parquet(str(tmp_path / "buffer"))
    n = rows.count()
    assert n >= 10 and rows.select("event_id").distinct().count() == n
