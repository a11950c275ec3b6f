"""Ranking, Pareto and ABC, cohorts, RFM and outliers.

Ranks and running shares over a whole table run in one task in Spark; here they are
computed by ranges of the order (ranges.running), so only one number a range meets in
one place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running as running_over_all


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys by falling total, with their share and cumulative share (their own included)."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    out = running_over_all(sums, [F.desc("total"), F.asc(key)], F.col("total"), "cum")
    return out.select(key, "total", F.try_divide("total", "cum_total").alias("share"), F.try_divide("cum", "cum_total").alias("cum_share"))


def abc(df: DataFrame, key: str, value: str, a: float = 0.8, b: float = 0.95) -> DataFrame:
    """Pareto with classes: A up to a cumulative share of a, B up to b, C beyond."""
    return pareto(df, key, value).withColumn("class", F.when(F.col("cum_share") <= a, "A").when(F.col("cum_share") <= b, "B").otherwise("C"))


def ntiles(df: DataFrame, order: list[Column], buckets: int, name: str) -> DataFrame:
    """Buckets of row counts as equal as can be, the larger first, in a total order."""
    ranked = running_over_all(df, order, None, "_n")
    size, extra = F.floor(F.col("_n_total") / buckets), F.col("_n_total") % buckets
    i = F.col("_n") - 1
    big = extra * (size + 1)
    bucket = F.when(i < big, F.floor(i / (size + 1))).otherwise(extra + F.floor(F.try_divide(i - big, size)))
    return ranked.withColumn(name, (bucket + 1).cast("long")).drop("_n", "_n_total")


def rfm(orders: DataFrame, customer: str, ts: str, amount: str, as_of, buckets: int = 5) -> DataFrame:
    """Recency (days), frequency and monetary value of each customer, with a score of each; the highest is best."""
    per = orders.groupBy(customer).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum(amount).alias("monetary"))
    per = per.withColumn("recency", F.datediff(F.lit(as_of).cast("date"), F.col("last").cast("date")).cast("long"))
    per = ntiles(per, [F.asc("last"), F.asc(customer)], buckets, "r")
    per = ntiles(per, [F.asc("frequency"), F.asc(customer)], buckets, "f")
    return ntiles(per, [F.asc("monetary"), F.asc(customer)], buckets, "m").drop("last")


def top_n(df: DataFrame, keys: list[str], value: str, n: int, tie: str, bottom: bool = False, ties: str = "row_number") -> DataFrame:
    """The n highest (or lowest) rows of each group, or of all if there are no keys."""
    order = [F.asc(value) if bottom else F.desc(value), F.asc(tie)]
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[ties]
    w = Window.partitionBy(*keys).orderBy(*(order if ties == "row_number" else order[:1]))
    return df.withColumn("rank", rank().over(w)).where(F.col("rank") <= n)


def positions(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each distinct value of a group with _before, the rows below it, _upto, those up to it, and _rows, all of the group's.

    Equal values are counted before they move, and a group may lie in many partitions.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    run = running_over_all(counts, [F.asc(c) for c in (*keys, value)], F.col("_c"), "_n")
    ends = run.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(F.col("_n") - F.col("_c")).alias("_s"), F.sum("_c").alias("_rows"))
    if keys:
        joined = run.join(ends, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    else:
        joined = run.crossJoin(F.broadcast(ends))
    return joined.select(*keys, value, (F.col("_n") - F.col("_c") - F.col("_s")).alias("_before"), (F.col("_n") - F.col("_s")).alias("_upto"), "_rows")


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles by group, interpolated between neighbours; a column for each named share. Nulls don't count.

    No task holds the distinct values of a group, as it would in percentile().
    """
    at = positions(df.where(F.col(value).isNotNull()), value, keys)
    out = {}
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_rows") - 1)
        low, high = (F.max(F.when((F.col("_before") <= i) & (i < F.col("_upto")), F.col(value))).cast("double") for i in (F.floor(place), F.ceil(place)))
        out[name] = low + (high - low) * F.max(place - F.floor(place))
    return at.groupBy(*keys).agg(*(c.alias(name) for name, c in out.items()))


def pct_rank(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """df with pct_rank and cume_dist of each row in its group, nulls lowest; from counts, so a large group is no single task."""
    at = positions(df, value, tuple(keys)).select(*(F.col(c).alias(f"_{c}") for c in (*keys, value)), F.when(F.col("_rows") > 1, F.col("_before") / (F.col("_rows") - 1)).otherwise(0.0).alias("pct_rank"), (F.col("_upto") / F.col("_rows")).alias("cume_dist"))
    return df.join(at, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, value)]).drop(*(f"_{c}" for c in (*keys, value)))


def first_purchase(orders: DataFrame, customer: str, ts: str) -> DataFrame:
    return orders.groupBy(customer).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def cohorts(orders: DataFrame, customer: str, ts: str, grain: str = "month") -> DataFrame:
    """(cohort, k, customers): of those who first bought in a period, how many bought k periods later."""
    p = orders.select(customer, F.date_trunc(grain, ts).cast("date").alias("p")).distinct()
    first = p.groupBy(customer).agg(F.min("p").alias("cohort"))
    step = F.months_between("p", "cohort").cast("long") if grain == "month" else (F.year("p") - F.year("cohort")).cast("long")
    return p.join(first, customer).groupBy("cohort", step.alias("k")).agg(F.count(F.lit(1)).alias("customers"))


def retention(cohort_counts: DataFrame) -> DataFrame:
    """Each cohort's customers of period k over those of period 0."""
    size = cohort_counts.where("k = 0").select("cohort", F.col("customers").alias("size"))
    return cohort_counts.join(size, "cohort").withColumn("retention", F.try_divide("customers", "size"))


def outliers_iqr(df: DataFrame, value: str, k: float = 1.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows outside the quartiles by more than k times their distance, with the bounds."""
    stats = quantiles(df, value, {"_a": 0.25, "_b": 0.75}, keys)
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    low, high = F.col("_a") - k * (F.col("_b") - F.col("_a")), F.col("_b") + k * (F.col("_b") - F.col("_a"))
    return joined.withColumn("low", low).withColumn("high", high).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).drop("_a", "_b")


def outliers_z(df: DataFrame, value: str, z: float = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    from .timeseries import zscore

    return zscore(df, value, keys, "z").where(F.abs("z") > z)


def share_of_total(df: DataFrame, keys: list[str], value: Column, name: str = "total") -> DataFrame:
    sums = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum(name).alias("_all")))).withColumn("share", F.try_divide(name, "_all")).drop("_all")


def heatmap(df: DataFrame, x: Column, y: Column, value: Column) -> DataFrame:
    """(x, y, v) in long form; value is an aggregate."""
    return df.groupBy(x.alias("x"), y.alias("y")).agg(value.alias("v"))


def kmeans_segments(features: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """Segments by k-means on standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), KMeans(featuresCol="_scaled", predictionCol="segment", k=k, seed=seed)]
    return Pipeline(stages=steps).fit(features).transform(features).drop("_raw", "_scaled")
