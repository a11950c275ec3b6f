"""Page models: what each page of a dashboard shows, as DataFrames with the question they answer.

Pages compute nothing of their own; drawing is left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import relational as rel
from ..operators import segments as sg
from ..operators import timeseries as ts
from .tools import chart_spec

Tables = Mapping[str, DataFrame]
Page = Callable[[Tables], dict[str, dict]]


def _fact(t: Tables) -> DataFrame:
    return rel.star(t["lineitem"], t["orders"], t["customer"], t["nation"], t["region"]).withColumn("revenue", rel.net())


def _monthly(t: Tables) -> DataFrame:
    return _fact(t).groupBy(ts.period("o_orderdate", "month").alias("month")).agg(F.sum("revenue").alias("revenue"))


def executive(t: Tables) -> dict[str, dict]:
    kpis = ag.exec_kpis(_fact(t), "o_orderkey", "o_custkey", "revenue", "l_quantity")
    return {
        "figures": chart_spec(kpis, "orders", "revenue", "How is the business doing?", kind="figures"),
        "trend": chart_spec(ts.running_total(_monthly(t), "month", "revenue"), "month", "revenue", "Is revenue rising?"),
    }


def sales(t: Tables) -> dict[str, dict]:
    return {
        "seasonality": chart_spec(ts.seasonality_index(t["orders"], "o_orderdate", "o_totalprice"), "month", "season_index", "Which months are strong?", kind="bar"),
        "heatmap": chart_spec(sg.heatmap(t["orders"], F.dayofweek("o_orderdate"), F.month("o_orderdate"), F.sum("o_totalprice")), "x", "y", "On which days and months do customers buy?", kind="heatmap"),
        "forecast": chart_spec(ts.forecast_trend_seasonal(t["orders"], "o_orderdate", "o_totalprice", 6), "period", "forecast", "What may the next months bring?"),
    }


def customers(t: Tables) -> dict[str, dict]:
    cohorts = sg.cohorts(t["orders"], "o_custkey", "o_orderdate")
    return {
        "retention": chart_spec(sg.retention(cohorts), "k", "retention", "Do customers come back?", "cohort", "heatmap"),
        "segments": chart_spec(sg.rfm(t["orders"], "o_custkey", "o_orderdate", "o_totalprice", "2001-08-02").groupBy("r", "f").agg(F.count(F.lit(1)).alias("n")), "r", "n", "Who are the best customers?", "f", "heatmap"),
    }


def products(t: Tables) -> dict[str, dict]:
    revenue = t["lineitem"].withColumn("revenue", rel.net())
    return {
        "pareto": chart_spec(sg.abc(revenue, "l_partkey", "revenue"), "l_partkey", "cum_share", "Which products make most of the revenue?"),
        "top": chart_spec(sg.top_n(revenue.groupBy("l_partkey").agg(F.sum("revenue").alias("v")), [], "v", 10, "l_partkey"), "l_partkey", "v", "What sells best?", kind="bar"),
        "returns": chart_spec(t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(ag.rate(F.col("l_returnflag") == "R").alias("rate")), "p_type", "rate", "What comes back?", kind="bar"),
    }


def regions(t: Tables) -> dict[str, dict]:
    return {"share": chart_spec(sg.share_of_total(_fact(t), ["r_name"], F.col("revenue")), "r_name", "share", "Where does revenue come from?", kind="bar")}


def data_quality(t: Tables) -> dict[str, dict]:
    return {"duplicates": chart_spec(ag.find_duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"]).groupBy("n").agg(F.count(F.lit(1)).alias("keys")), "n", "keys", "How many keys occur more than once?", kind="bar")}


def explorer(t: Tables) -> dict[str, dict]:
    return {"rows": chart_spec(rel.page(rel.search(t["customer"], ["c_name"], "1"), ["c_custkey"], 25), "c_custkey", "c_name", "Which raw rows match?", kind="table")}


PAGES: dict[str, Page] = {"Executive": executive, "Sales": sales, "Customers": customers, "Products": products, "Regions": regions, "Data quality": data_quality, "Raw data": explorer}
