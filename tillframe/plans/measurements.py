"""Load, filter, group, join and if/else, timed with their memory in Spark and in pandas; and how long data take to generate.

    python -m tillframe.plans.measurements FOLDER [ORDERS] > MEASUREMENTS.md

FOLDER holds the tables; the same is measured on so many generated orders and their lines.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as dq
from ..sources.files import scratch, table, workspace
from ..sources.generator import generate
from .tools import bench

COLUMNS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]


def cases(spark: SparkSession, sf_dir: str) -> Mapping[str, Mapping[str, Callable[[], object]]]:
    """Each arm reads its files anew, so all bear the cost of loading."""
    lines = lambda: table(spark, sf_dir, "lineitem").select(*COLUMNS)
    orders = lambda: table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p_lines = lambda: pd.read_parquet(f"{sf_dir}/lineitem.parquet", columns=COLUMNS)
    p_orders = lambda: pd.read_parquet(f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_custkey"])
    band = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "middle").otherwise("large")

    def p_band() -> pd.Series:
        q = p_lines()["l_quantity"]
        return pd.Series(np.select([q < 10, q < 30], ["small", "middle"], "large"))

    @F.udf("string")
    def slow(q):
        return "small" if q < 10 else "middle" if q < 30 else "large"

    return {
        "load": {"spark": lines, "pandas": p_lines},
        "filter": {"spark": lambda: lines().where("l_quantity < 10 and l_discount > 0.05"), "pandas": lambda: p_lines().query("l_quantity < 10 and l_discount > 0.05")},
        "groupby": {"spark": lambda: lines().groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v")), "pandas": lambda: p_lines().groupby("l_partkey", as_index=False)["l_extendedprice"].sum()},
        "join": {"spark": lambda: lines().join(orders(), F.col("l_orderkey") == F.col("o_orderkey")), "pandas": lambda: p_lines().merge(p_orders(), left_on="l_orderkey", right_on="o_orderkey")},
        "if/else": {"spark": lambda: lines().select(band.alias("b")), "spark, Python UDF": lambda: lines().select(slow("l_quantity").alias("b")), "numpy": p_band},
    }


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of lineitem in Parquet, and of its frame in pandas, before and after narrower types."""
    wide = table(spark, sf_dir, "lineitem")
    narrow, report = dq.downcast(wide)
    frame = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    small = frame.astype({c: {"tinyint": "int8", "smallint": "int16", "int": "int32"}[to] for c, _, to, _ in report.collect()} | {c: "category" for c in frame.columns if frame[c].dtype == object or str(frame[c].dtype).startswith("str")})
    size = lambda f: int(f.memory_usage(deep=True).sum())
    return spark.createDataFrame([("parquet, whole numbers narrowed", dq.stored_bytes(wide), dq.stored_bytes(narrow)), ("pandas, narrowed and categorical", size(frame), size(small))], "what string, bytes_before long, bytes_after long")


def markdown(df: DataFrame) -> str:
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *df.collect()]
    return "\n".join(f"| {' | '.join(map(show, r))} |" for r in rows)


def write_generated(spark: SparkSession, folder: str, n_orders: int) -> None:
    """Generated orders and lines, under the names that cases() reads, as Parquet."""
    orders = generate(spark, n_orders)["orders"]
    orders.select(F.col("order_id").alias("o_orderkey"), F.col("customer_id").alias("o_custkey"), "order_ts", "status").write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    i = F.col("i")
    lines = orders.select(F.col("order_id").alias("l_orderkey"), F.posexplode("items").alias("l_linenumber", "i"))
    lines = lines.select("l_orderkey", "l_linenumber", i["product_id"].alias("l_partkey"), i["qty"].cast("double").alias("l_quantity"), (i["qty"] * i["unit_price"]).cast("double").alias("l_extendedprice"), i["discount"].alias("l_discount"))
    lines.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")


def main(sf_dir: str, n_orders: int = 2_000_000) -> None:
    spark = SparkSession.builder.master("local[8]").appName("measurements").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Measurements\n\n`python -m tillframe.plans.measurements {sf_dir} {n_orders}`, local[8]; seconds are medians of 5 runs after one to warm up.\n")
    with workspace(spark):
        made = scratch(spark, "generated")
        took = bench(spark, {f"generate and write {n:,} orders": {"spark": lambda n=n: write_generated(spark, made, n)} for n in (n_orders // 10, n_orders)}, runs=2)
        print(f"## Generation\n\n{markdown(took)}\n")
        for folder, what in ((sf_dir, "given tables"), (made, "generated tables")):
            n = table(spark, folder, "lineitem").count()
            print(f"## {n:,} lines of {what}\n\n{markdown(bench(spark, cases(spark, folder)))}\n\n{markdown(savings(spark, folder))}\n")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
