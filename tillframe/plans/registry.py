"""The registered core queries: what each asks, as DataFrame code, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import aggregates as ag
from ..operators import quality as dq
from ..operators import ranges as rg
from ..operators import relational as rel
from ..operators import segments as sg
from ..operators import timeseries as ts
from ..sources import files
from ..sources.files import table
from ..streaming import live, state
from .cache import FileCache
from .tools import SETTINGS, Settings, chart_spec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _star(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return rel.star(lines, orders, table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region"))


def _r(c, n: int = 2):
    return F.round(c, n)


def _part(key: str):
    """A stretch of 50,000 values of a row's key: with the key distinct, groups divided by it are bounded."""
    return F.floor(F.col(key) / 50_000)


_STAR = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_MONTHS = "select cast(date_trunc('month', o_orderdate) as date) m, sum(o_totalprice) v from orders group by 1"

# ------------------------------------------------------------- KPIs, joins, groups


@query(f"select r_name, cast(date_trunc('month', o_orderdate) as date) as period, round(sum(l_extendedprice * (1 - l_discount)), 4) revenue from {_STAR} group by 1, 2")
def revenue_by_region_month(s, d):
    """Net revenue of each region by month."""
    return _star(s, d).groupBy("r_name", ts.period("o_orderdate", "month").alias("period")).agg(_r(F.sum(rel.net()), 4).alias("revenue"))


@query("select round(sum(l_extendedprice * (1 - l_discount)), 4) net, round(sum(l_extendedprice), 2) gross, round(sum(l_extendedprice * l_discount), 4) discount_cost, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) net_ratio from lineitem")
def kpi_revenue(s, d):
    """Net and gross revenue and what discounts cost (A14; driver tables have no cost for A15)."""
    return table(s, d, "lineitem").agg(_r(F.sum(rel.net()), 4).alias("net"), _r(F.sum("l_extendedprice")).alias("gross"), _r(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("discount_cost"), _r(fn.safe_ratio(F.sum(rel.net()), F.sum("l_extendedprice")), 6).alias("net_ratio"))


@query("with y as (select year(o_orderdate) y, sum(o_totalprice) r from orders group by 1) select cast(y as bigint) as year, round(r, 2) revenue, round((r - lag(r) over (order by y)) / lag(r) over (order by y), 6) growth from y")
def kpi_yoy(s, d):
    """Yearly revenue and its growth."""
    years = table(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("r"))
    return ts.period_delta(years, "year", "r").select("year", _r("r").alias("revenue"), _r("growth", 6).alias("growth"))


@query(f"with m as ({_MONTHS}) select a.m as month, round(a.v, 2) revenue, round((a.v - b.v) / b.v, 6) yoy from m a left join m b on b.m = cast(a.m - interval 12 month as date)")
def kpi_yoy_monthly(s, d):
    """Growth on the same month of the year before."""
    months = table(s, d, "orders").groupBy(ts.period("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return ts.yoy_monthly(months, "month", "v").select("month", _r("v").alias("revenue"), _r("yoy", 6).alias("yoy"))


@query("""with c as (select o_custkey, sum(l_extendedprice * (1 - l_discount)) r, count(distinct o_orderkey) o, sum(l_quantity) u from lineitem join orders on l_orderkey = o_orderkey group by 1)
select round(sum(r), 2) revenue, cast(sum(o) as bigint) orders, round(sum(u), 2) units, round(sum(r) / sum(o), 4) aov, count(*) active_customers, round(sum(case when o > 1 then 1 else 0 end) / count(*), 6) repeat_rate from c""")
def exec_kpis(s, d):
    """The executive figures: revenue, orders, units, average order, customers, repeat rate."""
    lines = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("r", rel.net())
    k = ag.exec_kpis(lines, "o_orderkey", "o_custkey", "r", "l_quantity")
    return k.select(_r("revenue").alias("revenue"), "orders", _r("units").alias("units"), _r("aov", 4).alias("aov"), "active_customers", _r("repeat_rate", 6).alias("repeat_rate"))


@query("select p_type, round(sum(case when l_returnflag = 'R' then 1 else 0 end) / count(*), 6) return_rate from lineitem join part on l_partkey = p_partkey group by 1")
def return_rate_by_category(s, d):
    """Which categories come back."""
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(_r(ag.rate(F.col("l_returnflag") == "R"), 6).alias("return_rate"))


@query("select n_name, count(*) customers, round(avg(c_acctbal), 4) balance from customer left join nation on c_nationkey = n_nationkey group by 1")
def merge_left(s, d):
    """Customers by nation, those without one kept."""
    out = rel.merge(table(s, d, "customer").withColumnRenamed("c_nationkey", "k"), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k", "left")
    return out.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), _r(F.avg("c_acctbal"), 4).alias("balance"))


@query("select coalesce(n_nationkey, c_nationkey, s_nationkey) as k, count(c_custkey) customers, count(s_suppkey) suppliers from nation full join (select * from customer where c_acctbal > 9000) on c_nationkey = n_nationkey full join (select * from supplier where s_acctbal > 9000) on s_nationkey = coalesce(n_nationkey, c_nationkey) group by 1")
def merge_full(s, d):
    """Rich customers and suppliers by nation, in full joins whose null keys match."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), "c_custkey")
    p = table(s, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return rel.merge(rel.merge(n, c, "k", "full", True), p, "k", "full", True).groupBy("k").agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def orders_without_lines(s, d):
    """Orders that hold nothing."""
    return rel.without_match(table(s, d, "orders"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("select 'orders' as child, count(*) n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'part', count(*) from lineitem where l_partkey not in (select p_partkey from part) union all select 'customer', count(*) from orders where o_custkey not in (select c_custkey from customer)")
def fk_violations(s, d):
    """Keys that lead nowhere."""
    line, orders = table(s, d, "lineitem"), table(s, d, "orders")
    n = lambda name, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "n")
    return rel.append_all(n("orders", rel.fk_violations(line, orders, "l_orderkey", "o_orderkey")), n("part", rel.fk_violations(line, table(s, d, "part"), "l_partkey", "p_partkey")), n("customer", rel.fk_violations(orders, table(s, d, "customer"), "o_custkey", "c_custkey")))


@query("select c_mktsegment, count(*) customers from customer where c_custkey in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R') group by 1")
def returning_customers(s, d):
    """Customers who sent something back, by segment."""
    back = table(s, d, "orders").join(table(s, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"))
    return rel.with_match(table(s, d, "customer"), back, "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query("select case when l_discount < 0.03 then 'low' when l_discount < 0.07 then 'middle' else 'high' end as band, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 4) revenue from lineitem group by 1")
def discount_bands(s, d):
    """Revenue by band of discount, by a range join."""
    bands = s.createDataFrame([("low", -1.0, 0.03), ("middle", 0.03, 0.07), ("high", 0.07, 2.0)], "band string, low double, high double")
    return rel.band(table(s, d, "lineitem"), "l_discount", bands).groupBy("band").agg(F.count(F.lit(1)).alias("lines"), _r(F.sum(rel.net()), 4).alias("revenue"))


@query("select e.event_id, p.event_id as purchase_id from events e asof left join (select event_id, user_id, ts from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type = 'error'")
def asof_last_purchase(s, d):
    """For each error the user's last purchase before it."""
    e = table(s, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return rel.nearest_before(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["purchase_id"]).select("event_id", "purchase_id")


_HOT = "case when user_id % 10 = 0 then user_id % 3 else -1 end"
_ASOF = f"""with u as (
  select {_HOT} k, ts, event_id, case when event_type = 'purchase' then event_id end p, case when event_type = 'purchase' then 0 else 1 end side from events where event_type in ('error', 'purchase')),
n as (
  select *, last_value(case when side = 0 then (ts, p) end ignore nulls) over (partition by k order by ts, side, p rows unbounded preceding) b,
    last_value(case when side = 0 then (ts, p) end ignore nulls) over (partition by k order by ts desc, side desc, p desc rows between unbounded preceding and 1 preceding) f from u)"""


def _errors_and_purchases(s, d):
    e = table(s, d, "events").withColumn("k", F.expr(_HOT))
    return e.where("event_type = 'error'").select("event_id", "k", "ts"), e.where("event_type = 'purchase'").select("k", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))


@query(f"{_ASOF} select event_id, case when b[1] >= ts - interval 10 minute then b[2] end as purchase_id from n where side = 1")
def asof_within_minutes(s, d):
    """For each error the last purchase in the ten minutes before it, in a group that nine tenths of the rows share."""
    errors, bought = _errors_and_purchases(s, d)
    return rg.asof(errors, bought, ["k"], "ts", "bought", ["purchase_id"], tolerance=600_000_000).select("event_id", "purchase_id")


@query(f"{_ASOF} select event_id, case when f is null or ts - b[1] <= f[1] - ts then b[2] else f[2] end as purchase_id from n where side = 1")
def asof_nearest(s, d):
    """For each error the purchase nearest in time, before or after, in such a group."""
    errors, bought = _errors_and_purchases(s, d)
    return rg.asof(errors, bought, ["k"], "ts", "bought", ["purchase_id"], "nearest").select("event_id", "purchase_id")


_OFFERS = "select p_partkey, timestamp '1995-01-01' + to_days(cast(p_partkey * 37 % 2400 as integer)) as since, timestamp '1995-01-01' + to_days(cast(p_partkey * 37 % 2400 + p_size % 9 as integer)) as upto, p_retailprice price from part"


@query(f"select o_orderkey, count(p_partkey) offers, round(min(price), 2) cheapest from orders left join ({_OFFERS}) on o_orderdate >= since and o_orderdate < upto group by 1")
def offers_at_order(s, d):
    """How many products were on offer when an order came in, by an interval join in bins.

    Offers of one interval are added up first, and moments are joined once each: however
    many products there are, at most 36 intervals of whole days hold a moment.
    """
    day = lambda c: F.timestamp_add("DAY", c, F.expr("timestamp_ntz'1995-01-01'"))
    start = F.col("p_partkey") * 37 % 2400
    offers = table(s, d, "part").select("p_partkey", day(start).alias("since"), day(start + F.col("p_size") % 9).alias("upto"), F.col("p_retailprice").alias("price"))
    spans = offers.groupBy("since", "upto").agg(F.count("p_partkey").alias("n"), F.min("price").alias("least"))
    orders = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    moments = orders.select(F.col("o_orderdate").alias("moment")).where("moment is not null").distinct()
    found = rg.interval_join(moments, spans, "moment", "since", "upto").groupBy("moment").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    each = orders.join(found, F.col("o_orderdate") == F.col("moment"), "left")
    return each.groupBy("o_orderkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offers"), _r(F.min("least")).alias("cheapest"))


@query(f"select r_name, c_mktsegment, cast(grouping(r_name) as bigint) g_region, cast(grouping(c_mktsegment) as bigint) g_segment, count(*) orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, c_mktsegment)")
def cube_region_segment(s, d):
    """Orders by region and segment with all totals."""
    places = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    base = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return base.cube("r_name", "c_mktsegment").agg(F.grouping("r_name").cast("long").alias("g_region"), F.grouping("c_mktsegment").cast("long").alias("g_segment"), F.count(F.lit(1)).alias("orders"))


@query(f"select r_name, n_name, cast(grouping(r_name) * 2 + grouping(n_name) as bigint) as level, round(sum(l_extendedprice * (1 - l_discount)), 4) revenue from {_STAR} group by rollup (r_name, n_name)")
def rollup_region_nation(s, d):
    """Revenue by region and nation with subtotals."""
    return ag.multi_group(_star(s, d), ["r_name", "n_name"], {"revenue": _r(F.sum(rel.net()), 4)}, subtotals=True)


@query(f"select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) revenue from {_STAR} where r_name = 'ASIA' group by 1, 2")
def drill_down_asia(s, d):
    """One step of a drill-down: the nations of a region (C14)."""
    return ag.drill(_star(s, d), ["r_name", "n_name"], {"revenue": _r(F.sum(rel.net()), 4)}, 1, {"r_name": "ASIA"})


@query("select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders")
def transform_share(s, d):
    """Each order's share of its customer's spending (A2)."""
    return ag.group_transform(table(s, d, "orders"), ["o_custkey"], "t", F.sum("o_totalprice")).select("o_orderkey", _r(F.col("o_totalprice") / F.col("t"), 6).alias("share"))


@query("select p_brand, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) wmean from lineitem join part on l_partkey = p_partkey group by 1")
def custom_weighted_mean(s, d):
    """Mean price weighted by quantity, by brand (A4)."""
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(_r(ag.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("wmean"))


@query("select event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) wmean from events group by 1")
def udaf_weighted_mean(s, d):
    """The same by grouped pandas UDFs, over parts of each type."""
    e = table(s, d, "events").withColumn("w", (F.col("event_id") % 7 + 1).cast("double"))
    return ag.weighted_mean_udf(e, ["event_type"], "value", "w", _part("event_id"), "wmean").select("event_type", _r("wmean", 6).alias("wmean"))


@query("select event_type, round(max(value) - min(value), 6) as spread from events group by 1")
def group_apply_spread(s, d):
    """A pandas function of the parts of each group, whose results are merged."""
    def ends(p):
        return p.groupby("event_type", as_index=False, dropna=False).agg(low=("value", "min"), high=("value", "max"))

    parts = ag.group_apply(table(s, d, "events").select("event_type", "value", _part("event_id").alias("part")), ["event_type", "part"], ends, "event_type string, low double, high double")
    return parts.groupBy("event_type").agg(_r(F.max("high") - F.min("low"), 6).alias("spread"))


_FLAGS = ["A", "N", "R"]


@query("select p_type, round(avg(case when l_returnflag = 'A' then l_quantity end), 6) as A, round(avg(case when l_returnflag = 'N' then l_quantity end), 6) as N, round(avg(case when l_returnflag = 'R' then l_quantity end), 6) as R from lineitem join part on l_partkey = p_partkey group by 1")
def pivot_quantity(s, d):
    """Mean quantity, category by return flag (A5)."""
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ag.pivot(j, ["p_type"], "l_returnflag", _FLAGS, {"q": _r(F.avg("l_quantity"), 6)})


@query("select case when grouping(o_orderstatus) = 1 then 'All' else o_orderstatus end as o_orderstatus, cast(sum(case when year(o_orderdate) = 1995 then 1 else 0 end) as bigint) as \"1995\", cast(sum(case when year(o_orderdate) = 1996 then 1 else 0 end) as bigint) as \"1996\", cast(sum(case when year(o_orderdate) in (1995, 1996) then 1 else 0 end) as bigint) as \"All\" from orders group by rollup (o_orderstatus)")
def crosstab_status_year(s, d):
    """Orders by status and year, with margins."""
    o = table(s, d, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    return ag.crosstab(o, "o_orderstatus", "y", ["1995", "1996"], margins=True)


@query("select p_partkey, 'p_size' as measure, cast(p_size as double) as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def melt_part(s, d):
    """Product measures in long form."""
    return ag.melt(table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"], "measure", "value")


@query("select o_orderkey, l_partkey, l_quantity from orders left join lineitem on l_orderkey = o_orderkey")
def explode_items(s, d):
    """Orders' nested items as rows; empty orders keep one."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("items"))
    return ag.explode_items(table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "items"))


@query("""with b as (select cast(unnest(range(min(date_trunc('day', o_orderdate)), max(o_orderdate) + interval 1 day, interval 1 day)) as date) period from orders)
select b.period, round(coalesce(sum(o_totalprice), 0), 2) revenue, count(o_orderkey) orders from b left join orders on cast(o_orderdate as date) = b.period group by 1""")
def resample_daily(s, d):
    """Daily revenue, days without orders at zero."""
    out = ts.resample(table(s, d, "orders"), "o_orderdate", "day", {"revenue": F.sum("o_totalprice"), "orders": F.count("o_orderkey")}, fill={"revenue": 0.0, "orders": 0})
    return out.select("period", _r("revenue").alias("revenue"), "orders")


@query("select cast(date_trunc('month', o_orderdate) + interval 1 month - interval 1 day as date) as month_end, round(sum(o_totalprice), 2) revenue from orders group by 1")
def resample_month_end(s, d):
    """Monthly revenue under the month's last day."""
    return table(s, d, "orders").groupBy(ts.period("o_orderdate", "month", "end").alias("month_end")).agg(_r(F.sum("o_totalprice")).alias("revenue"))


@query("""select 'l_quantity' as "column", count(*)::double n, round(avg(l_quantity), 6) mean, round(stddev_samp(l_quantity), 6) std_samp, round(stddev_pop(l_quantity), 6) std_pop, round(var_samp(l_quantity), 4) var_samp, min(l_quantity) as "min", round(quantile_cont(l_quantity, 0.25), 6) p25, round(median(l_quantity), 6) median, round(quantile_cont(l_quantity, 0.75), 6) p75, max(l_quantity) as "max",
round((select avg(power(l_quantity - m, 3)) / power(avg(power(l_quantity - m, 2)), 1.5) from lineitem, (select avg(l_quantity) m from lineitem)), 4) skewness, round((select avg(power(l_quantity - m, 4)) / power(avg(power(l_quantity - m, 2)), 2) - 3 from lineitem, (select avg(l_quantity) m from lineitem)), 4) kurtosis from lineitem""")
def describe_quantity(s, d):
    """The statistics of a measure, sample and population apart."""
    places = {"n": None, "min": None, "max": None, "var_samp": 4, "skewness": 4, "kurtosis": 4}
    out = ag.describe_stats(table(s, d, "lineitem"), ["l_quantity"])
    return out.select("column", *(F.col(c) if places.get(c, 6) is None else _r(c, places.get(c, 6)).alias(c) for c in out.columns[1:]))


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem" for a in _COLS for b in _COLS))
def correlation_matrix(s, d):
    """How measures move together."""
    return ag.corr_matrix(table(s, d, "lineitem"), _COLS).select("a", "b", _r("corr", 6).alias("corr"))


@query("select round(covar_samp(l_quantity, l_discount), 6) covariance, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 2) intercept from lineitem")
def regression(s, d):
    """Covariance and the line of price on quantity."""
    return table(s, d, "lineitem").agg(_r(F.covar_samp("l_quantity", "l_discount"), 6).alias("covariance"), _r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), _r(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query(" union all ".join(f"select '{a}' as i, '{b}' as j, round(sum({a} * {b}), 2) as v from lineitem" for a in ("l_quantity", "l_discount") for b in ("l_quantity", "l_discount")))
def gram_matrix(s, d):
    """The matrix product of measures with themselves."""
    return ag.gram(table(s, d, "lineitem"), ["l_quantity", "l_discount"]).select("i", "j", _r("v").alias("v"))


@query("with m as (select c_nationkey as i, c_mktsegment as j, sum(c_acctbal) as v from customer group by 1, 2) select a.j as i, b.j as j, round(sum(a.v * b.v), 0) as v from m a join m b on a.i = b.i group by 1, 2")
def matrix_product(s, d):
    """Segments by segments: a matrix times its transpose, in long form."""
    m = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("i"), F.col("c_mktsegment").alias("j")).agg(F.sum("c_acctbal").alias("v"))
    return ag.matmul(ag.transpose(m), m).select("i", "j", _r("v", 0).alias("v"))


@query("select p_brand, count(distinct l_orderkey) n, count(distinct l_suppkey) suppliers from lineitem join part on l_partkey = p_partkey group by 1")
def distinct_orders(s, d):
    """Orders that hold a brand, and its suppliers."""
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


# ------------------------------------------------------------- windows and series

_DAILY = "select cast(o_orderdate as date) o_date, sum(o_totalprice) v from orders group by 1"


def _daily(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("o_date")).agg(F.sum("o_totalprice").alias("v"))


@query(f"with t as ({_DAILY}) select o_date, case when count(v) over w >= 7 then round(avg(v) over w, 4) end ma7 from t window w as (order by o_date rows between 6 preceding and current row)")
def moving_average_7(s, d):
    """Seven-day moving average of revenue, once there are seven."""
    return ts.rolling(_daily(s, d), "o_date", "v", 7).select("o_date", _r("rolling", 4).alias("ma7"))


@query(f"with t as ({_DAILY}) select o_date, round(stddev_samp(v) over w, 2) sd, round(max(v) over w, 2) hi, round(min(v) over w, 2) lo, round(sum(v) over w, 2) total from t window w as (order by o_date rows between 29 preceding and current row)")
def rolling_30(s, d):
    """Thirty-day rolling deviation, extremes and sum."""
    df = _daily(s, d)
    for name, f in (("sd", F.stddev_samp), ("hi", F.max), ("lo", F.min), ("total", F.sum)):
        df = ts.rolling(df, "o_date", "v", 30, f, min_periods=1, name=name)
    return df.select("o_date", *(_r(c).alias(c) for c in ("sd", "hi", "lo", "total")))


@query("select event_id, round(sum(value) over (partition by user_id order by cast(ts as date) range between interval 6 days preceding and current row), 4) as week from events")
def rolling_week_by_user(s, d):
    """What each user spent in the week up to an event."""
    return ts.rolling_days(table(s, d, "events"), "ts", "value", 7, keys=("user_id",), name="week").select("event_id", _r("week", 4).alias("week"))


@query("select p_partkey, round((p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ()), 6) scaled, round((p_retailprice - avg(p_retailprice) over ()) / stddev_samp(p_retailprice) over (), 6) z from part")
def normalise_prices(s, d):
    """Prices scaled to 0..1 and standardised."""
    return ts.zscore(ts.minmax(table(s, d, "part"), "p_retailprice"), "p_retailprice").select("p_partkey", _r("scaled", 6).alias("scaled"), _r("z", 6).alias("z"))


@query("select p_partkey, round((p_retailprice - avg(p_retailprice) over (partition by p_type)) / stddev_samp(p_retailprice) over (partition by p_type), 6) z from part")
def standardise_by_type(s, d):
    """Prices standardised within their category."""
    return ts.zscore(table(s, d, "part"), "p_retailprice", ("p_type",)).select("p_partkey", _r("z", 6).alias("z"))


_ABC = """with s as (select l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 4) total from lineitem group by 1),
t as (select l_partkey, total, sum(total) over (order by total desc, l_partkey rows unbounded preceding) / sum(total) over () c, total / sum(total) over () share from s)"""


def _revenue_by_part(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(_r(F.sum(rel.net()), 4).alias("rev"))


@query(f"{_ABC} select l_partkey, total, round(share, 8) as share, round(c, 6) cum_share from t")
def pareto_products(s, d):
    """Products by revenue with their cumulative share."""
    return sg.pareto(_revenue_by_part(s, d), "l_partkey", "rev").select("l_partkey", "total", _r("share", 8).alias("share"), _r("cum_share", 6).alias("cum_share"))


@query(f"{_ABC} select case when c <= 0.8 then 'A' when c <= 0.95 then 'B' else 'C' end as class, count(*) products, round(sum(total), 3) revenue from t group by 1")
def abc_products(s, d):
    """How many products make the first 80 and 95 per cent."""
    return sg.abc(_revenue_by_part(s, d), "l_partkey", "rev").groupBy("class").agg(F.count(F.lit(1)).alias("products"), _r(F.sum("total"), 3).alias("revenue"))


_TOP = "select l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 4) rev from lineitem group by 1 order by rev {}, l_partkey limit 10"


@query(_TOP.format("desc"))
def top_products(s, d):
    """The ten best sellers."""
    return sg.top_n(_revenue_by_part(s, d), [], "rev", 10, "l_partkey")


@query(_TOP.format("asc"))
def bottom_products(s, d):
    """The ten worst sellers."""
    return sg.top_n(_revenue_by_part(s, d), [], "rev", 10, "l_partkey", bottom=True)


@query("select p_type, p_partkey, p_retailprice, cast(rn as bigint) as \"rank\" from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) rn from part) where rn <= 3")
def top_3_by_type(s, d):
    """The three dearest products of each category."""
    return sg.top_n(table(s, d, "part"), ["p_type"], "p_retailprice", 3, "p_partkey").select("p_type", "p_partkey", "p_retailprice", F.col("rank").cast("long").alias("rank"))


@query("select event_id, count(*) over w n, round(avg(value) over w, 7) mean, min(value) over w low, max(value) over w high from events window w as (order by ts, event_id rows between 49 preceding and current row)")
def rolling_50_events(s, d):
    """What the last fifty events, of whatever user, were worth (W1, W2), over raw rows in ranges with a halo."""
    e = table(s, d, "events").select("event_id", "ts", "value")
    out = rg.rolling_rows(e, ["ts", "event_id"], 50, {"n": F.count(F.lit(1)), "mean": F.avg("value"), "low": F.min("value"), "high": F.max("value")})
    return out.select("event_id", "n", _r("mean", 7).alias("mean"), "low", "high")


@query("select event_id, count(*) over w n, round(sum(value) over w, 4) total, round(stddev_samp(value) over w, 4) sd from events window w as (partition by event_type order by ts range between interval 6 hour preceding and current row)")
def rolling_hours_by_type(s, d):
    """Events of a type in the six hours up to each (W2, W3); a type is as many tasks as it has ranges."""
    e = table(s, d, "events").select("event_id", "event_type", "ts", "value")
    out = rg.rolling_moments(e, "ts", 6 * 3_600_000_000, "value", ("event_type",))
    return out.select("event_id", "n", _r("total", 4).alias("total"), _r("sd", 4).alias("sd"))


@query("select event_id, cast(row_number() over w as bigint) as number, round(sum(value) over (order by ts, event_id rows unbounded preceding), 3) as running from events window w as (order by ts, event_id)")
def running_events(s, d):
    """Each event's number and what all up to it were worth (W14), by carried totals."""
    e = table(s, d, "events").select("event_id", "ts", "value")
    numbered = rg.running(e, ["ts", "event_id"], None, "number")
    return rg.running(numbered, ["ts", "event_id"], F.col("value")).select("event_id", "number", _r("running", 3).alias("running"))


@query(f"with t as ({_DAILY}) select o_date, round(v - lag(v) over w, 2) delta, round(lead(v) over w, 2) as following from t window w as (order by o_date)")
def lag_lead(s, d):
    """Change on the day before, and the day after."""
    return ts.period_delta(_daily(s, d), "o_date", "v").select("o_date", _r("delta").alias("delta"), _r("next").alias("following"))


@query("""with c as (select o_custkey, max(o_orderdate) a, count(*) b, sum(o_totalprice) m from orders group by 1),
t as (select ntile(5) over (order by a, o_custkey) r, ntile(5) over (order by b, o_custkey) f, ntile(5) over (order by round(m, 2), o_custkey) m from c)
select cast(r as bigint) r, cast(f as bigint) f, cast(m as bigint) m, count(*) customers from t group by 1, 2, 3""")
def rfm_cells(s, d):
    """Customers by recency, frequency and value, in fifths."""
    orders = table(s, d, "orders")
    return sg.rfm(orders, "o_custkey", "o_orderdate", "o_totalprice", "2001-08-02").groupBy("r", "f", "m").agg(F.count(F.lit(1)).alias("customers"))


@query("select p_partkey, round(percent_rank() over w, 6) pct_rank, round(cume_dist() over w, 6) cume_dist from part window w as (partition by p_type order by p_retailprice)")
def percent_ranks(s, d):
    """Where a price stands in its category."""
    return sg.pct_rank(table(s, d, "part"), "p_retailprice", ["p_type"]).select("p_partkey", _r("pct_rank", 6).alias("pct_rank"), _r("cume_dist", 6).alias("cume_dist"))


@query("select o_custkey, cast(min(o_orderdate) as date) as first, cast(max(o_orderdate) as date) as last from orders group by 1")
def first_last_purchase(s, d):
    """A customer's first and last purchase."""
    return sg.first_purchase(table(s, d, "orders"), "o_custkey", "o_orderdate").select("o_custkey", F.col("first_ts").cast("date").alias("first"), F.col("last_ts").cast("date").alias("last"))


@query(f"with m as ({_MONTHS}) select cast(month(m) as bigint) as month, round(avg(v) / (select avg(v) from m), 6) season_index from m group by 1")
def seasonality(s, d):
    """Which months are strong."""
    return ts.seasonality_index(table(s, d, "orders"), "o_orderdate", "o_totalprice").select("month", _r("season_index", 6).alias("season_index"))


@query(f"with m as ({_MONTHS}) select m as period, round(v, 2) revenue, round(sum(v) over (order by m rows unbounded preceding), 2) running from m")
def sales_trend(s, d):
    """Monthly revenue and its running total."""
    months = table(s, d, "orders").groupBy(ts.period("o_orderdate", "month").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    return ts.running_total(months, "period", "v").select("period", _r("v").alias("revenue"), _r("running").alias("running"))


# ------------------------------------------------------------- composites

_OUT = "select event_type, count(*) n from events, (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events) where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) group by 1"


@query(_OUT)
def outliers_iqr(s, d):
    """Events with values far outside the quartiles."""
    return sg.outliers_iqr(table(s, d, "events"), "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) n from (select event_type, abs(value - avg(value) over ()) / stddev_samp(value) over () z from events) where z > 3 group by 1")
def outliers_zscore(s, d):
    """Events more than three deviations out."""
    return sg.outliers_z(table(s, d, "events"), "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_COHORT = """with p as (select distinct o_custkey, cast(date_trunc('month', o_orderdate) as date) p from orders), f as (select o_custkey, min(p) c from p group by 1),
k as (select c as cohort, (year(p) - year(c)) * 12 + month(p) - month(c) as k, count(*) customers from p join f using (o_custkey) group by 1, 2)"""


@query(f"{_COHORT} select cohort, cast(k as bigint) as k, customers from k")
def cohorts_monthly(s, d):
    """Cohorts of first purchase, month by month."""
    return sg.cohorts(table(s, d, "orders"), "o_custkey", "o_orderdate")


@query("with f as (select o_custkey, min(o_orderdate) fd from orders group by 1) select cast(date_trunc('year', fd) as date) as cohort, cast(year(o_orderdate) - year(fd) as bigint) as k, count(distinct o.o_custkey) customers from orders o join f on o.o_custkey = f.o_custkey group by 1, 2")
def cohorts_yearly(s, d):
    """Cohorts of first purchase, year by year."""
    return sg.cohorts(table(s, d, "orders"), "o_custkey", "o_orderdate", "year")


@query(f"{_COHORT} select a.cohort, cast(a.k as bigint) as k, a.customers, b.customers as size, round(a.customers / b.customers, 6) retention from k a join k b on a.cohort = b.cohort and b.k = 0")
def retention_monthly(s, d):
    """How many of a cohort still buy (C4)."""
    return sg.retention(sg.cohorts(table(s, d, "orders"), "o_custkey", "o_orderdate")).withColumn("retention", _r("retention", 6))


@query("select cast(dayofweek(o_orderdate) as bigint) as x, cast(month(o_orderdate) as bigint) as y, round(sum(o_totalprice), 2) as v from orders group by 1, 2")
def heatmap_weekday_month(s, d):
    """Revenue by weekday (Sunday 0) and month."""
    return sg.heatmap(table(s, d, "orders"), fn.weekday_sunday0(F.col("o_orderdate")), F.month("o_orderdate").cast("long"), _r(F.sum("o_totalprice")))


@query(f"""with m as ({_MONTHS}), n as (select m, v, (year(m) - year(z)) * 12 + month(m) - month(z) t from m, (select min(m) z from m)),
f as (select regr_slope(v, t) a, regr_intercept(v, t) b, max(t) l, max(m) e, avg(v) o from n), s as (select month(m) cm, avg(v) mean from m group by 1),
g as (select *, unnest(range(1, 7)) k from f)
select cast(e + to_months(cast(k as integer)) as date) as period, round((b + a * (l + k)) * mean / o, 0) forecast from g join s on cm = month(cast(e + to_months(cast(k as integer)) as date))""")
def forecast_6_months(s, d):
    """The next six months by trend and season (C11)."""
    return ts.forecast_trend_seasonal(table(s, d, "orders"), "o_orderdate", "o_totalprice", 6).select("period", _r("forecast", 0).alias("forecast"))


@query(f"""with recursive m as ({_MONTHS}), n as (select row_number() over (order by m) i, v from m),
h(i, level, trend) as (select cast(1 as bigint), a.v, coalesce(b.v - a.v, 0) from n a left join n b on b.i = 2 where a.i = 1
union all select n.i, 0.5 * n.v + 0.5 * (level + trend), 0.3 * (0.5 * n.v + 0.5 * (level + trend) - level) + 0.7 * trend from h join n on n.i = h.i + 1)
select cast(k as integer) as step, round(level + k * trend, 2) forecast from (select * from h order by i desc limit 1), (select unnest(range(1, 4)) k)""")
def forecast_holt(s, d):
    """The next three months by double exponential smoothing (C11)."""
    months = table(s, d, "orders").groupBy(ts.period("o_orderdate", "month").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    return ts.holt(months, "period", "v", 0.5, 0.3, 3).select("step", _r("forecast").alias("forecast"))


@query(f"with t as (select r_name, sum(l_extendedprice * (1 - l_discount)) v from {_STAR} group by 1) select r_name, round(v, 2) revenue, round(v / sum(v) over (), 6) as share from t")
def region_share(s, d):
    """Each region's share of revenue."""
    return sg.share_of_total(_star(s, d), ["r_name"], rel.net(), "v").select("r_name", _r("v").alias("revenue"), _r("share", 6).alias("share"))


@query()
def kmeans_customers(s, d):
    """Customers in four groups by frequency and value (C7, optional model)."""
    per = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("v"))
    return sg.kmeans_segments(per, ["n", "v"], 4)


# ------------------------------------------------------------- quality

def _rules():
    return {"ships_after_order": F.col("l_shipdate") >= F.col("o_orderdate"), "discount_in_range": F.col("l_discount").between(0, 0.08), "positive_quantity": F.col("l_quantity") > 0}


def _checked(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("select reason, count(*) n from (select unnest([case when l_shipdate < o_orderdate then 'ships_after_order' end, case when not (l_discount between 0 and 0.08) then 'discount_in_range' end, case when l_quantity <= 0 then 'positive_quantity' end]) reason from lineitem join orders on l_orderkey = o_orderkey) where reason is not null group by 1")
def dq_rejections(s, d):
    """Why lines are quarantined."""
    return dq.dq_summary(dq.validate_rows(_checked(s, d), _rules())[1])


@query("select count(*) accepted from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate and l_discount between 0 and 0.08 and l_quantity > 0")
def dq_accepted(s, d):
    """How many lines pass all rules."""
    return dq.validate_rows(_checked(s, d), _rules())[0].agg(F.count(F.lit(1)).alias("accepted"))


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_lines(s, d):
    """Line keys that occur more than once."""
    return ag.find_duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) rn from lineitem) where rn = 1")
def dedup_lines(s, d):
    """One line for each key, the same in every run."""
    return ag.dedup(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("with t as (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_totalprice end p, case when o_orderkey % 7 = 0 then null else o_orderpriority end q from orders) select o_orderkey, round(coalesce(p, (select median(p) from t where q is not null)), 2) p, q, p is null as p_was_null from t where q is not null")
def null_strategies(s, d):
    """Drop, impute and flag, a strategy for each column."""
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("p"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("q"))
    out = dq.handle_nulls(o.withColumn("f", F.col("p")), {"q": dq.Drop(), "f": dq.Flag(), "p": dq.Impute("median")})
    return out.select("o_orderkey", _r("p").alias("p"), "q", F.col("f_missing").alias("p_was_null"))


@query("select case when c_custkey % 10 <> 0 then c_custkey end as c_custkey, c_custkey % 10 <> 0 as accepted, case when c_custkey % 10 = 0 then 'x' else '' end || c_custkey || ',' || c_nationkey || ',' || c_mktsegment as line from customer")
def csv_quarantine(s, d):
    """Customers as CSV, every tenth malformed: the rows that load, and the others' raw lines."""
    customers = table(s, d, "customer")
    key = F.concat(F.when(F.col("c_custkey") % 10 == 0, "x").otherwise(""), F.col("c_custkey").cast("string"))
    path = files.scratch(s, "customers")
    files.export_csv(customers.select(key.alias("c_custkey"), "c_nationkey", "c_mktsegment"), path)
    good, bad = files.load_csv(s, path, _schema("c_custkey long, c_nationkey int, c_mktsegment string"))
    lines = good.select("c_custkey", F.lit(True).alias("accepted"), F.concat_ws(",", *good.columns).alias("line"))
    return lines.unionByName(bad.select("c_custkey", F.lit(False).alias("accepted"), F.col(files.CORRUPT).alias("line")))


@query("select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderstatus <> 'P' group by 1")
def processed_zone(s, d):
    """Orders written to the processed zone by status, and read back with whole folders left out."""
    path = files.scratch(s, "processed")
    files.write_processed(table(s, d, "orders"), path, ("o_orderstatus",))
    back = files.load_parquet(s, path).where("o_orderstatus <> 'P'")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice")).alias("total"))


@query("""select "column", violation, rows from (values
  ('o_channel', 'missing', (select count(*) from orders)), ('o_orderpriority', 'unexpected', (select count(*) from orders)),
  ('o_custkey', 'bigint, not smallint', (select count(*) from orders where o_custkey > 32767)),
  ('o_totalprice', 'double, not decimal(18,1)', (select count(*) from orders where round(o_totalprice, 1) <> o_totalprice)),
  ('o_orderdate', 'timestamp_ntz, not date', (select count(*) from orders where o_orderdate <> date_trunc('day', o_orderdate)))) t("column", violation, rows)""")
def schema_violations(s, d):
    """Where orders, as read, depart from a declared schema, and in how many rows."""
    declared = _schema("o_orderkey long not null, o_custkey smallint, o_orderstatus string, o_totalprice decimal(18,1), o_orderdate date, o_channel string")
    return dq.schema_report(table(s, d, "orders"), declared)


@query("select count(*) as rows, cast(count(*) filter (l_discount between 0 and 0.08) as bigint) accepted, cast(count(*) filter (not (l_discount between 0 and 0.08)) as bigint) rejected from lineitem")
def logged_counts(s, d):
    """Rows in, accepted and rejected, counted by the pass that writes a stage's rows."""
    lines, seen = dq.logged(table(s, d, "lineitem").select("l_orderkey", "l_discount"), "lines", F.col("l_discount").between(0, 0.08))
    files.discard(files.written(lines, "lines"))
    dq.report("lines", seen)
    return s.createDataFrame([tuple(seen.get[c] for c in ("rows", "accepted", "rejected"))], "rows long, accepted long, rejected long")


@query("select event_id, try_cast(case when event_id % 3 = 0 then 'x' || event_id else cast(event_id as varchar) end as bigint) as n, try_cast(case when event_id % 5 = 0 then 'nan?' else cast(user_id as varchar) end as double) as v from events")
def convert_types(s, d):
    """Dirty text to numbers, null where it isn't one (P5)."""
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string")).alias("n"), F.when(F.col("event_id") % 5 == 0, "nan?").otherwise(F.col("user_id").cast("string")).alias("v"))
    return rel.convert(e, _schema("event_id long, n long, v double"))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


@query("select p_type, cast(dense_rank() over (order by p_type) - 1 as bigint) as p_type_code, n from (select p_type, count(*) n from part group by 1)")
def encode_categories(s, d):
    """A category's code and how often it occurs (P10)."""
    encoded, _ = dq.dictionary_encode(table(s, d, "part"), "p_type")
    return encoded.groupBy("p_type", F.col("p_type_code").cast("long").alias("p_type_code")).agg(F.count(F.lit(1)).alias("n"))


_WHOLE = {"l_orderkey": ("bigint", 8), "l_partkey": ("bigint", 8), "l_suppkey": ("bigint", 8), "l_linenumber": ("int", 4)}


@query("with t as (" + " union all ".join(f"select '{c}' as \"column\", '{k}' as was, {b} as wide, case when min({c}) >= -128 and max({c}) <= 127 then 1 when min({c}) >= -32768 and max({c}) <= 32767 then 2 when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 4 else 8 end as width from lineitem" for c, (k, b) in _WHOLE.items()) + ") select \"column\", was, case width when 1 then 'tinyint' when 2 then 'smallint' else 'int' end as now, cast(wide - width as integer) as bytes_saved from t where width < wide")
def downcast_report(s, d):
    """What narrower types save a row."""
    return dq.narrowest(table(s, d, "lineitem"))


@query("select cast(count(*) as bigint) as lines, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) k from events")
def json_property(s, d):
    """A figure out of JSON text (F8)."""
    return table(s, d, "events").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


# ------------------------------------------------------------- pages: filter, search, paginate, functions


@query("select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 100000 and o_totalprice <= 300000 and o_orderpriority = '1-URGENT'")
def sidebar_filters(s, d):
    """Several filters at once, pushed to the scan."""
    return rel.apply_filters(table(s, d, "orders"), {"o_orderstatus": {"F", "O"}, "o_totalprice": (100000.0, 300000.0), "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name from customer where c_name ilike '%77%' or c_mktsegment ilike '%build%'")
def search_customers(s, d):
    """Customers in which a text occurs."""
    hit = rel.search(table(s, d, "customer"), ["c_name"], "77").select("c_custkey", "c_name")
    return hit.unionByName(rel.search(table(s, d, "customer"), ["c_mktsegment"], "Build").select("c_custkey", "c_name")).distinct()


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 order by o_totalprice, o_orderkey limit 25")
def page_of_orders(s, d):
    """The page after a given row, by key and not by offset (L2, L3)."""
    return rel.page(table(s, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 25, (100000.0, 1 << 62)).select("o_orderkey", "o_totalprice")


@query("select p_partkey, upper(trim(p_name)) as name, regexp_replace(p_brand, '[^0-9]', '', 'g') as digits, case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as size_band from part")
def clean_and_band(s, d):
    """Cleaned names and banded sizes."""
    return table(s, d, "part").select("p_partkey", F.upper(fn.clean_text(F.col("p_name"))).alias("name"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), fn.bands(F.col("p_size"), [10, 30], ["small", "middle", "large"]).alias("size_band"))


@query("select o_orderkey, cast(year(o_orderdate) as bigint) y, cast(quarter(o_orderdate) as bigint) q, cast(o_orderdate + interval 3 month as date) due, cast(date_diff('day', cast(o_orderdate as date), date '2002-01-01') as bigint) age from orders")
def date_functions(s, d):
    """Parts of dates, dates ahead, and ages."""
    return table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q"), F.add_months(F.col("o_orderdate").cast("date"), 3).alias("due"), F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"))


@query("select o_custkey, round(sum(o_totalprice * o_totalprice), 0) as energy, cast(count(*) as bigint) as n from orders group by 1")
def array_functions(s, d):
    """Inner products over arrays of a customer's orders, each of one stretch of order keys, and their sum."""
    a = table(s, d, "orders").groupBy("o_custkey", _part("o_orderkey").alias("part")).agg(F.collect_list("o_totalprice").alias("v"))
    return a.groupBy("o_custkey").agg(_r(F.sum(fn.dot(F.col("v"), F.col("v"))), 0).alias("energy"), F.sum(F.size("v")).cast("long").alias("n"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersection(s, d):
    """Nations with both customers and suppliers."""
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("select 'customer' as kind, c_custkey as id, c_acctbal as balance from customer union all select 'supplier', s_suppkey, s_acctbal from supplier")
def union_parties(s, d):
    """Customers and suppliers in one list."""
    return rel.append_all(table(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), table(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("""with d as (select cast(unnest(range(date_trunc('day', min(o_orderdate)), max(o_orderdate) + interval 1 second, interval 1 day)) as date) as date from orders)
select date, dayofweek(date) in (0, 6) as weekend from d""")
def calendar_udtf(s, d):
    """The days from the first order to the last, from a table function in a lateral join."""
    span = table(s, d, "orders").agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    return fn.calendar_of(span, "first", "last").select("date", "weekend")


@query("""with g as (select o_custkey, cast(o_orderdate as date) as d from orders),
r as (select *, case when d - lag(d) over (partition by o_custkey order by d) <= 60 then 0 else 1 end b from g),
n as (select *, sum(b) over (partition by o_custkey order by d rows unbounded preceding) run from r)
select o_custkey, cast(run as bigint) run, min(d) first_day, max(d) last_day, count(*) n from n group by 1, 2""")
def order_runs(s, d):
    """Runs of a customer's orders, each at most sixty days after the one before, from a table function over the table, dealt out by customer."""
    orders = table(s, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return fn.runs(orders, "o_custkey", "day", 60, undated=True)


# ------------------------------------------------------------- layouts, sketches, models, variants, caches


_STRATEGIES = ["broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl"]


@query(" union all ".join(f"select '{x}' as strategy, count(*) n, round(sum(o_totalprice), 2) total from customer join orders on c_custkey = o_custkey where c_custkey <= 500" for x in _STRATEGIES))
def join_strategies(s, d):
    """One join by each of Spark's strategies, as they are measured; of some customers, as one of them is a nested loop."""
    customers = table(s, d, "customer").where("c_custkey <= 500").select("c_custkey")
    orders = table(s, d, "orders").select("o_custkey", "o_totalprice")
    joined = lambda x: orders.join(rel.hinted(customers, x), F.col("c_custkey") == F.col("o_custkey"))
    return rel.append_all(*(joined(x).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice")).alias("total")).select(F.lit(x).alias("strategy"), "n", "total") for x in _STRATEGIES))


@query("select case when l_quantity < 10 then 'small' when l_quantity < 30 then 'middle' else 'large' end as band, count(*) n, 0::bigint as different from lineitem group by 1")
def vectorised_bands(s, d):
    """Quantities banded by an expression and by a vectorised Python function, and where they differ."""
    lines = table(s, d, "lineitem").select(fn.bands(F.col("l_quantity"), [10, 30], ["small", "middle", "large"]).alias("band"), fn.bands_udf([10, 30], ["small", "middle", "large"])("l_quantity").alias("other"))
    return lines.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("band").eqNullSafe(F.col("other")), 1)).alias("different"))


@query(f"{_ABC} select case when c <= 0.7 then 'A' when c <= 0.9 then 'B' else 'C' end as class, count(*) products, round(sum(total), 1) revenue from t group by 1")
def abc_by_settings(s, d):
    """The ABC classes by the thresholds of a settings file, which the environment may override."""
    settings = Settings.load(SETTINGS, {"TILLFRAME_ABC_B": "0.9"})
    found = sg.abc(_revenue_by_part(s, d), "l_partkey", "rev", settings.abc_a, settings.abc_b)
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("products"), _r(F.sum("total"), 1).alias("revenue"))


@query(f"with m as ({_MONTHS}) select m as period, round(v, 2) revenue from m")
def trend_chart(s, d):
    """What the chart of the sales trend is drawn from, under the question it answers."""
    months = table(s, d, "orders").groupBy(ts.period("o_orderdate", "month").alias("period")).agg(_r(F.sum("o_totalprice")).alias("revenue"))
    return chart_spec(months, "period", "revenue", "How do sales develop?")["data"]


@query("select o_orderstatus, count(*) n, round(sum(l_extendedprice), 2) total from orders join lineitem on l_orderkey = o_orderkey group by 1")
def bucketed_join(s, d):
    """Lines and orders joined where they lie, in buckets of the order key."""
    orders = files.bucketed(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "orders", ["o_orderkey"], 8)
    lines = files.bucketed(table(s, d, "lineitem").select("l_orderkey", "l_extendedprice"), "lines", ["l_orderkey"], 8)
    joined = rel.hinted(orders, "merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_extendedprice")).alias("total"))


@query(f"with e as (select event_id, event_type, {_HOT} k from events), t as (select k, event_type, count(*) n from e group by 1, 2) select event_id, t.event_type as other, n from e left join t on e.k = t.k and t.event_type <> e.event_type")
def salted_join(s, d):
    """Each event with what else its group did, by a join whose hot key is dealt over salts."""
    e = table(s, d, "events").select("event_id", "event_type", F.expr(_HOT).alias("k"))
    others = e.groupBy("k", F.col("event_type").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    return rel.salted_join(e, others, ["k"], "left").where("other <> event_type").select("event_id", "other", "n")


_SPANS = "select cast(i % 15 as integer) a, cast(i % 15 + 1 + i // 2 as integer) b from (select unnest(range(0, 30)) i)"


@query(f"""with s as (select cast(timestamp '2024-01-01' + to_days(a) as date) since, cast(timestamp '2024-01-01' + to_days(b) as date) upto from ({_SPANS}))
select since, upto, count(distinct user_id) users, true as within from s left join events on ts >= since and ts < upto group by 1, 2""")
def active_users_by_sketch(s, d):
    """Active users of thirty spans of days, counted, and whether the day's sketches, united, come within 2 %."""
    e = table(s, d, "events").select("ts", "user_id")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    i = F.col("id")
    spans = s.range(30).select(day(i % 15).alias("since"), day(i % 15 + 1 + F.floor(i / 2)).alias("upto"))
    sketches = ag.daily_sketches(e, "ts", "user_id")
    estimated = ag.distinct_in_spans(sketches, spans, "since", "upto")
    days = e.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    counted = rg.interval_join(days, spans, "day", "since", "upto").groupBy("since", "upto").agg(F.countDistinct("user_id").alias("users"))
    both = estimated.join(counted, ["since", "upto"], "left").withColumn("users", F.coalesce("users", F.lit(0)))
    return both.select("since", "upto", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.02 * F.col("users")).alias("within"))


def _solved(y: str, xs: list[str]) -> str:
    """SQL that solves the normal equations of y on xs by elimination, and gives the errors of the coefficients."""
    c, p = ["1.0", *xs], len(xs) + 1
    rows = [[f"sum({a} * {b})" for b in c] + [f"sum({a} * {y})"] + [f"{float(i == j)}" for j in range(p)] for i, a in enumerate(c)]
    name = lambda i, j: f"m{i}_{j}"
    steps = [f"t0 as (select {', '.join(f'cast({x} as double) {name(i, j)}' for i, r in enumerate(rows) for j, x in enumerate(r))}, count(*) n, sum({y} * {y}) yy, {', '.join(f'sum({a} * {y}) r{i}' for i, a in enumerate(c))} from lineitem)"]
    for k in range(p):
        reduced = lambda i, j, k=k: f"{name(k, j)} / {name(k, k)}" if i == k else f"{name(i, j)} - {name(i, k)} * {name(k, j)} / {name(k, k)}"
        steps.append(f"t{k + 1} as (select {', '.join(f'{reduced(i, j)} {name(i, j)}' for i in range(p) for j in range(2 * p + 1))}, n, yy, {', '.join(f'r{i}' for i in range(p))} from t{k})")
    rest = f"(yy - {' - '.join(f'r{i} * {name(i, p)}' for i in range(p))}) / (n - {p})"
    out = " union all ".join(f"select '{t}' as term, {name(i, p)} b, sqrt({rest} * {name(i, p + 1 + i)}) e from t{p}" for i, t in enumerate(["constant", *xs]))
    return f"with {', '.join(steps)} select term, round(b, 3) coefficient, round(e, 3) std_error from ({out})"


_XS = ["l_quantity", "l_discount", "l_tax"]


@query(_solved("l_extendedprice", _XS))
def price_regression(s, d):
    """What a line's price depends on: three regressors and their errors, from one pass."""
    out = ag.regression(table(s, d, "lineitem"), "l_extendedprice", _XS)
    return out.select("term", _r("coefficient", 3).alias("coefficient"), _r("std_error", 3).alias("std_error"))


@query("""with e as (select event_type, event_id % 3 = 0 vip, event_id % 4 c, cast(json_extract_string(props, '$.k') as bigint) k, round(value, 2) v from events)
select event_type, 'k' as property, 'number' as kind, count(*) n, round(sum(k), 2) total from e group by 1 union all select event_type, 'v', 'number', count(*), round(sum(v), 2) from e group by 1
union all select event_type, 'user', 'object', count(*), null from e group by 1 union all select event_type, 'vip', 'boolean', count(*), null from e group by 1
union all select event_type, 'channel', 'string', count(*), null from e where c < 2 group by 1 union all select event_type, 'channel', 'number', count(*), round(sum(c), 2) from e where c >= 2 group by 1""")
def variant_properties(s, d):
    """What properties events have and of what types, parsed once to VARIANT (F8)."""
    e = table(s, d, "events")
    channel = F.when(F.col("event_id") % 4 < 2, F.concat(F.lit('"c'), F.col("event_id") % 4, F.lit('"'))).otherwise((F.col("event_id") % 4).cast("string"))
    more = F.concat(F.lit('{"vip": '), (F.col("event_id") % 3 == 0).cast("string"), F.lit(', "v": '), F.format_string("%.2f", F.round("value", 2)), F.lit(', "user": {"id": '), F.col("user_id").cast("string"), F.lit('}, "channel": '), channel, F.lit(", "), F.substring("props", 2, 1 << 20))
    parsed = e.select("event_type", F.try_parse_json(more).alias("props"))
    return ag.properties(parsed, "props", ("event_type",)).withColumn("total", _r("total"))


@query("select step, n, round(total, 2) total, hit from (select 1 as step, count(*) n, sum(c_acctbal) total, false as hit from customer union all select 2, count(*), sum(c_acctbal), true from customer union all select 3, count(*), sum(c_acctbal), false from customer where c_acctbal > 0)")
def cache_follows_files(s, d):
    """A table read through the cache twice, rewritten, and read again: the third time it sees the new rows."""
    path, found = files.scratch(s, "cached"), []
    cache = FileCache(s)
    customers = table(s, d, "customer").select("c_custkey", "c_acctbal")
    for step, rows in enumerate((customers, None, customers.where("c_acctbal > 0")), 1):
        if rows is not None:
            rows.write.mode("overwrite").parquet(path)
        before = cache.hits
        total = cache.get(("customers",), [path], lambda: s.read.parquet(path)).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"))
        seen = files.written(total, "seen")  # as it is now, whatever becomes of the files
        found.append(seen.select(F.lit(step).alias("step"), "n", _r("total").alias("total"), F.lit(cache.hits > before).alias("hit")))
    cache.clear()
    return rel.append_all(*found)


# ------------------------------------------------------------- time windows, in batch as on a stream


@query("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def tumbling_daily(s, d):
    """Events by day and type, by the windows of the live panel."""
    e = table(s, d, "events")
    out = live.tumbling(e, "ts", "1 day", keys=("event_type",), n=F.count(F.lit(1)), total=F.sum("value"))
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", _r("total", 4).alias("total"))


@query("select cast(floor(epoch(w)) as bigint) as start, count(*) n from (select unnest(range(time_bucket(interval 6 hour, ts) - interval 18 hour, time_bucket(interval 6 hour, ts) + interval 1 second, interval 6 hour)) w from events) group by 1")
def sliding_daily(s, d):
    """Events in the day from every sixth hour on."""
    out = live.sliding(table(s, d, "events"), "ts", "1 day", "6 hours", n=F.count(F.lit(1)))
    return out.select(F.unix_timestamp(F.col("window.start").cast("timestamp")).alias("start"), "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hour then 0 else 1 end b from events window w as (partition by user_id order by ts)),
n as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) s from g)
select user_id, cast(floor(epoch(min(ts))) as bigint) as start, count(*) n from n group by user_id, s""")
def sessions(s, d):
    """Runs of a user's events with gaps under twelve hours."""
    out = live.session(table(s, d, "events"), "ts", "12 hours", ("user_id",), n=F.count(F.lit(1)))
    return out.select("user_id", F.unix_timestamp(F.col("session_window.start").cast("timestamp")).alias("start"), "n")


def _events(s, path: str):
    """Events and their schema, the local time of each as an instant, as watermarks want it, in whatever zone the session is."""
    ts = F.expr("timestampadd(microsecond, timestampdiff(microsecond, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz)), timestamp'1970-01-01T00:00:00Z')")
    kept = table(s, path, "events").select("event_id", ts.alias("ts"), "event_type", "value", "user_id")
    return kept, kept.schema


@query("""with b as (select event_id, event_type, value, ts, cast(date_trunc('day', ts) as date) as day from events), w1 as (select max(ts) - interval 10 day as w from b where event_id % 10 <> 0), w2 as (select max(ts) - interval 10 day as w from b)
select day, event_type, count(*) n, round(sum(value), 4) total from b, w1, w2 where (event_id % 10 <> 0 or day + interval 1 day > w1.w) and day + interval 1 day <= w2.w group by 1, 2""")
def stream_late_rows(s, d):
    """Daily events from a stream: closed days alone, and rows left out that come after their day was closed."""
    events, schema = _events(s, d)
    feed, out, check = (files.scratch(s, n) for n in ("feed", "days", "days-state"))
    for late in (False, True):
        events.where((F.col("event_id") % 10 == 0) == late).write.mode("append").parquet(feed)
        stream = s.readStream.schema(schema).parquet(feed)
        days = live.tumbling(stream, "ts", "1 day", "10 days", ("event_type",), n=F.count(F.lit(1)), total=F.sum("value"))
        live.run_to_end(days.select(F.col("window.start").alias("start"), "event_type", "n", "total"), out, check)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86400).cast("int"))
    return s.read.parquet(out).select(day.alias("day"), "event_type", "n", _r("total", 4).alias("total"))


@query("select event_type, count(*) n, cast(sum(event_id) as bigint) ids from events group by 1")
def stream_dedup(s, d):
    """Events delivered twice by a stream, each counted once."""
    events, schema = _events(s, d)
    feed, out, check = (files.scratch(s, n) for n in ("twice", "once", "once-state"))
    for _ in range(2):
        events.write.mode("append").parquet(feed)
        live.run_to_end(live.dedup_stream(s.readStream.schema(schema).parquet(feed), ["event_id"], "ts", "10 days"), out, check)
    return s.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("select event_type, count(*) n, round(sum(value), 4) total from events group by 1")
def stream_state(s, d):
    """Running totals by type, kept in state between two deliveries of a stream, a type's rows dealt over salts."""
    events, schema = _events(s, d)
    feed, out, check = (files.scratch(s, n) for n in ("deliveries", "totals", "totals-state"))
    with state.rocksdb(s):
        for half in range(2):
            events.where(F.pmod("event_id", F.lit(2)) == half).write.mode("append").parquet(feed)
            totals = live.latest_by_key(live.stateful_totals(s.readStream.schema(schema).parquet(feed), "event_type", "ts", "value"), out, check, ["event_type", "salt"])
    return totals.groupBy("event_type").agg(F.sum("n").alias("n"), _r(F.sum("total"), 4).alias("total"))


_MIDDLE = "2024-01-16"


def _halves(events, ts: str = "ts"):
    """A table in two deliveries, the earlier rows first."""
    middle = F.lit(f"{_MIDDLE}T00:00:00Z").cast("timestamp")
    return events.where(F.col(ts) < middle), events.where(F.col(ts) >= middle)


@query(f"""with e as (select user_id, ts, value, event_type, ts < timestamp '{_MIDDLE}' early from events),
r as (select *, row_number() over (partition by user_id order by ts desc) k, row_number() over (partition by user_id, early order by ts desc) ke from e),
g as (
  select user_id, 'total' as what, null as w, max(ts) last_ts, count(*) n, sum(value) t, count(*) filter (event_type = 'click') clicks, sum(value) filter (k <= 3) recent from r group by 1
  union all select user_id, 'inactive', (select max(ts) from e), max(ts), count(*), sum(value), count(*) filter (event_type = 'click'), sum(value) filter (k <= 3) from r group by 1
  union all select user_id, 'inactive', (select max(ts) from e where early), max(ts), count(*), sum(value), count(*) filter (event_type = 'click'), sum(value) filter (ke <= 3) from r where early group by 1)
select user_id, what, n, round(t, 4) total, epoch_us(last_ts) last_us, clicks, round(recent, 4) recent from g where w is null or last_ts + interval 12 hour <= w - interval 1 day""")
def stream_activity(s, d):
    """Each user's totals from a stream in two deliveries, and an alert for those who were inactive for twelve hours."""
    events, schema = _events(s, d)
    feed, out, check = (files.scratch(s, n) for n in ("halves", "activity", "activity-state"))
    with state.rocksdb(s):
        for half in _halves(events):
            half.write.mode("append").parquet(feed)
            stream = s.readStream.schema(schema).parquet(feed)
            rows = live.run_updates(state.activity(stream, {"user_id": F.col("user_id")}, "ts", F.col("value"), F.col("event_type"), 12 * 3_600_000), out, check)
    totals = live.latest(rows.where("what = 'total'"), ["user_id"])
    both = totals.unionByName(rows.where("what = 'inactive'").drop("batch"))
    sums = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x)
    return both.select("user_id", "what", "n", _r("total", 4).alias("total"), "last_us", F.coalesce(F.col("kinds")["click"], F.lit(0)).alias("clicks"), _r(sums, 4).alias("recent"))


@query("select event_type, count(*) n, cast(sum(event_id) as bigint) ids from events group by 1")
def live_buffer(s, d):
    """Events that a stream appended to the live buffer in two deliveries, each once."""
    events, schema = _events(s, d)
    feed, out, check = (files.scratch(s, n) for n in ("source", "buffer", "buffer-state"))
    for half in _halves(events):
        half.write.mode("append").parquet(feed)
        buffer = live.start_buffer(s.readStream.schema(schema).parquet(feed), out, check, "1 second")
        buffer.processAllAvailable()
        buffer.stop()
    return s.read.schema(schema).parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""with v as (select event_id, user_id, ts from events where event_type = 'view'), p as (select event_id as purchase_id, user_id, ts from events where event_type = 'purchase'),
w as (select least((select max(ts) from v), (select max(ts) from p)) - interval 2 day w)
select v.event_id, purchase_id from v left join p on v.user_id = p.user_id and p.ts >= v.ts and p.ts <= v.ts + interval 1 day, w where purchase_id is not null or v.ts + interval 1 day < w""")
def stream_follow_ups(s, d):
    """Views joined to their user's purchases of the next day, as two streams; views that nothing followed, once that is certain."""
    events, _ = _events(s, d)
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    feed, feed_too, out, check = (files.scratch(s, n) for n in ("views", "purchases", "follow-ups", "follow-ups-state"))
    with state.rocksdb(s):
        for a, b in zip(_halves(views), _halves(bought, "bought"), strict=True):
            a.write.mode("append").parquet(feed)
            b.write.mode("append").parquet(feed_too)
            streams = (s.readStream.schema(x.schema).parquet(path) for x, path in ((views, feed), (bought, feed_too)))
            live.run_to_end(state.follow_ups(*streams, ["user_id"], "ts", "bought", "1 day", "2 days"), out, check)
    return s.read.parquet(out).select("event_id", "purchase_id")


@query("select cast(floor(epoch(date_trunc('hour', ts))) as bigint) as start, count(*) n, round(sum(value), 4) revenue, round(avg(value), 7) average from events where event_type = 'purchase' group by 1")
def live_panel(s, d):
    """The live panel: purchases by hour, updated as two deliveries come in (T4)."""
    events, _ = _events(s, d)
    sales = events.where("event_type = 'purchase'").select("ts", F.col("value").alias("amount"))
    feed, out, check = (files.scratch(s, n) for n in ("sales", "panel", "panel-state"))
    for half in _halves(sales):
        half.write.mode("append").parquet(feed)
        stream = s.readStream.schema(sales.schema).parquet(feed)
        query_ = live.start_live_panel(stream, out, check, "1 second", "1 hour")
        query_.processAllAvailable()
        query_.stop()
    panel = live.live_panel(stream, out, "1 hour")
    return panel.select(F.unix_seconds("start").alias("start"), "n", _r("revenue", 4).alias("revenue"), _r("average", 7).alias("average"))


@query("""with l as (select p_type, l_extendedprice * (1 - l_discount) revenue, l_extendedprice * (0.4 + (p_partkey * 37 % 100) / 250.0) as cost from lineitem join part on l_partkey = p_partkey)
select p_type, round(sum(revenue), 2) revenue, round(sum(cost), 2) as cost, round(sum(revenue) - sum(cost), 2) profit, round((sum(revenue) - sum(cost)) / sum(revenue), 6) margin from l group by 1""")
def generated_margin(s, d):
    """Margin by category, under costs generated for the given products, which have none: 40 to 80 per cent of the price, by key."""
    lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    share = 0.4 + (F.col("p_partkey") * 37 % 100) / 250.0
    out = ag.kpi_margin(lines.withColumn("revenue", rel.net()).withColumn("cost", F.col("l_extendedprice") * share), ["p_type"], "revenue", "cost")
    return out.select("p_type", _r("revenue").alias("revenue"), _r("cost").alias("cost"), _r("profit").alias("profit"), _r("margin", 6).alias("margin"))
