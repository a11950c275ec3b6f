"""A seeded synthetic retail data set.

Every random number is a hash of the seed, a stream name and the row's id, so a table is
the same however it is partitioned, and any row can be made alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = ["North", "South", "East", "West"]
CATEGORIES = ["Grocery", "Clothing", "Electronics", "Home", "Toys"]
PAYMENTS = ["card", "cash", "transfer", "voucher"]
SEGMENTS = ["consumer", "business", "partner"]
CARRIERS = ["road", "air", "courier"]
REASONS = ["damaged", "unwanted", "wrong item", "late"]
#: Share of lines returned by category, sales weight by month and by region.
RETURN_RATE = [0.01, 0.12, 0.06, 0.04, 0.05]
MONTH_WEIGHT = [0.8, 0.75, 0.9, 0.95, 1.0, 1.0, 0.95, 0.9, 1.0, 1.1, 1.4, 1.8]
REGION_WEIGHT = [4, 3, 2, 1]
START, DAYS = "2022-01-01", 3 * 365


def uniform(seed: int, stream: str, *ids: Column) -> Column:
    """Uniform in [0, 1), by seed, stream and ids alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *ids), F.lit(1 << 53)) / F.lit(float(1 << 53))


def zipf_pick(u: Column, n: int, s: float = 1.1) -> Column:
    """1..n with frequency about k**-s: the inverse of the continuous distribution."""
    top = (n + 1) ** (1 - s) - 1
    return F.least(F.lit(n), F.greatest(F.lit(1), F.floor(F.pow(1 + u * F.lit(top), F.lit(1 / (1 - s)))))).cast("long")


def weighted_pick(u: Column, weights: list[float]) -> Column:
    """The number, from 0, of the weight that u falls on."""
    total, before, out = sum(weights), 0.0, F.lit(len(weights) - 1)
    cuts = []
    for w in weights[:-1]:
        before += w / total
        cuts.append(before)
    for k in reversed(range(len(cuts))):
        out = F.when(u < cuts[k], k).otherwise(out)
    return out


def _choice(u: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in names)), (F.floor(u * len(names)) + 1).cast("int"))


def order_day(seed: int, id_: Column) -> Column:
    """The day of an order: months by their weight, days within evenly."""
    months = math.ceil(DAYS / 30.4)
    weights = [MONTH_WEIGHT[k % 12] for k in range(months)]
    month = weighted_pick(uniform(seed, "month", id_), weights)
    return F.add_months(F.lit(START).cast("date"), month.cast("int")) + F.floor(uniform(seed, "day", id_) * 28).cast("int")


def generate(spark: SparkSession, n_orders: int, seed: int = 42) -> dict[str, DataFrame]:
    """All tables of schemas.TABLES, as lazy DataFrames, for so many orders."""
    n_customers, n_products, n_stores = max(10, n_orders // 10), max(20, min(50_000, n_orders // 50)), max(4, min(2_000, n_orders // 500))
    u = lambda stream, *ids: uniform(seed, stream, *(ids or (F.col("id"),)))
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    small = lambda names, key: spark.createDataFrame([(k + 1, x) for k, x in enumerate(names)], f"{key} int, name string")
    id_ = F.col("id")

    def price(product: Column) -> Column:
        return money(F.exp(uniform(seed, "price", product) * 4) + 1)

    def category(product: Column) -> Column:
        return (F.floor(uniform(seed, "category", product) * len(CATEGORIES)) + 1).cast("int")

    customers = spark.range(1, n_customers + 1).select(id_.alias("customer_id"), F.concat(F.lit("Customer "), id_).alias("name"), (weighted_pick(u("c_region"), REGION_WEIGHT) + 1).cast("int").alias("region_id"), _choice(u("segment"), SEGMENTS).alias("segment"), (F.lit(START).cast("date") - F.floor(u("signup") * 700).cast("int")).alias("signup_date"))
    products = spark.range(1, n_products + 1).select(id_.alias("product_id"), F.concat(F.lit("Product "), id_).alias("name"), category(id_).alias("category_id"), price(id_).alias("unit_price"), money(price(id_).cast("double") * (0.4 + 0.4 * u("cost"))).alias("unit_cost"))
    stores = spark.range(1, n_stores + 1).select(id_.alias("store_id"), F.concat(F.lit("Store "), id_).alias("name"), (weighted_pick(u("s_region"), REGION_WEIGHT) + 1).cast("int").alias("region_id"), (F.lit(START).cast("date") - F.floor(u("opened") * 3000).cast("int")).alias("opened_date"))

    def item(k: Column) -> Column:
        product = zipf_pick(u("product", id_, k), n_products)
        return F.struct(product.alias("product_id"), (F.floor(u("qty", id_, k) * 5) + 1).cast("int").alias("qty"), price(product).alias("unit_price"), (F.floor(u("disc", id_, k) * u("disc2", id_, k) * 6) * 0.05).alias("discount"))

    orders = spark.range(1, n_orders + 1).select(
        id_.alias("order_id"), (F.floor(F.pow(u("customer"), 1.6) * n_customers) + 1).cast("long").alias("customer_id"), (F.floor(u("store") * n_stores) + 1).cast("long").alias("store_id"), (weighted_pick(u("payment"), [6, 2, 1, 1]) + 1).cast("int").alias("payment_method_id"),
        (order_day(seed, id_).cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(u("second") * 86400))).alias("order_ts"), F.when(u("status") < 0.95, "complete").otherwise("cancelled").alias("status"), F.transform(F.sequence(F.lit(1), (F.floor(u("lines") * 4) + 1).cast("int")), item).alias("items"),
    )
    lines = orders.select("order_id", "order_ts", F.posexplode("items").alias("line", "i"))
    rate = F.element_at(F.array(*(F.lit(x) for x in RETURN_RATE)), category(F.col("i.product_id")))
    returns = lines.where(uniform(seed, "return", F.col("order_id"), F.col("line")) < rate).select(
        (F.col("order_id") * 8 + F.col("line")).alias("return_id"), "order_id", F.col("i.product_id").alias("product_id"), (F.col("order_ts") + F.make_dt_interval(days=(F.floor(uniform(seed, "late", F.col("order_id")) * 30) + 1).cast("int"))).alias("return_ts"), F.lit(1).cast("int").alias("qty"), _choice(uniform(seed, "reason", F.col("order_id"), F.col("line")), REASONS).alias("reason"))
    shipping = orders.where("status = 'complete'").select("order_id", F.col("order_ts").alias("o"), uniform(seed, "ship", F.col("order_id")).alias("u")).select("order_id", (F.col("o") + F.make_dt_interval(hours=(F.floor(F.col("u") * 72) + 1).cast("int"))).alias("ship_ts"), (F.col("o") + F.make_dt_interval(hours=(F.floor(F.col("u") * 240) + 12).cast("int"))).alias("delivered_ts"), _choice(uniform(seed, "carrier", F.col("order_id")), CARRIERS).alias("carrier"), money(3 + 9 * F.col("u")).alias("cost"))
    discounts = spark.range(1, 13).select(id_.cast("int").alias("discount_id"), F.concat(F.lit("SAVE"), id_).alias("code"), ((id_ % 5 + 1) * 0.05).alias("pct"), F.add_months(F.lit(START).cast("date"), (id_ * 3).cast("int") - 3).alias("start_date"), F.add_months(F.lit(START).cast("date"), (id_ * 3).cast("int") - 2).alias("end_date"))
    return {
        "customers": customers, "orders": orders, "products": products, "stores": stores, "returns": returns, "discounts": discounts, "shipping": shipping,
        "regions": small(REGIONS, "region_id").withColumn("parent_region_id", F.lit(None).cast("int")), "categories": small(CATEGORIES, "category_id").withColumn("parent_id", F.lit(None).cast("int")), "payment_methods": small(PAYMENTS, "payment_method_id"), "time_dimension": time_dimension(spark, START, DAYS + 31),
    }


def time_dimension(spark: SparkSession, start: str, days: int) -> DataFrame:
    d = F.date_add(F.lit(start).cast("date"), F.col("id").cast("int"))
    dates = spark.range(days).select(d.alias("date"))
    return dates.select(F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.weekofyear("date").alias("week"), F.dayofweek("date").alias("dow"), F.dayofweek("date").isin(1, 7).alias("is_weekend"), F.date_format("date", "MM-dd").isin("01-01", "12-25").alias("is_holiday"))
