"""Time series: resampling, rolling windows, growth, seasonality and forecasts.

A window over a whole series runs in one task, so every function here that needs one
works on rows already aggregated to periods, or is partitioned by keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def period(ts: str, freq: str, label: str = "start") -> Column:
    """The period that ts is in, as the date it begins or ends on."""
    start = F.date_trunc(freq, F.col(ts)).cast("date")
    return start if label == "start" else F.date_sub(F.expr(f"cast({_start(ts, freq)} + {_STEP[freq]} as date)"), 1)


def _start(ts: str, freq: str) -> str:
    return f"cast(date_trunc('{freq}', {ts}) as date)"


def spine(df: DataFrame, keys: list[str], ts: str, freq: str) -> DataFrame:
    """Every period between the first and last of ts, for every key that occurs."""
    ends = df.agg(F.min(period(ts, freq)).alias("a"), F.max(period(ts, freq)).alias("b"))
    periods = ends.select(F.explode(F.sequence("a", "b", F.expr(_STEP[freq]))).alias("period"))
    return periods if not keys else df.select(*keys).distinct().crossJoin(F.broadcast(periods))


def resample(df: DataFrame, ts: str, freq: str, outputs: Mapping[str, Column], keys: tuple[str, ...] = (), fill: Mapping[str, object] | None = None) -> DataFrame:
    """Aggregates by period; periods without rows appear, null or as fill says."""
    sums = df.groupBy(*keys, period(ts, freq).alias("period")).agg(*(c.alias(k) for k, c in outputs.items()))
    out = spine(df, list(keys), ts, freq).join(sums, [*keys, "period"], "left")
    return out.fillna(dict(fill)) if fill else out


def _over(order: list[str] | str, keys: tuple[str, ...]):
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(df: DataFrame, order: str | list[str], value: str, n: int, fn=F.avg, keys: tuple[str, ...] = (), min_periods: int | None = None, name: str = "rolling") -> DataFrame:
    """fn over the last n rows; null before min_periods (n, unless given) values."""
    w = _over(order, keys).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= (n if min_periods is None else min_periods), fn(value).over(w)))


def rolling_days(df: DataFrame, ts: str, value: str, days: int, fn=F.sum, keys: tuple[str, ...] = (), name: str = "rolling") -> DataFrame:
    """fn over the rows of the last so many days, this one included."""
    at = F.unix_date(F.col(ts).cast("date"))
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-(days - 1), 0)
    return df.withColumn(name, fn(value).over(w))


def minmax(df: DataFrame, value: str, keys: tuple[str, ...] = (), name: str = "scaled") -> DataFrame:
    """Min-max scaling, by the extremes of all rows or of a row's group."""
    return _with_stats(df, keys, F.min(value).alias("_a"), F.max(value).alias("_b")).withColumn(name, F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def zscore(df: DataFrame, value: str, keys: tuple[str, ...] = (), name: str = "z") -> DataFrame:
    """Standardisation by the sample deviation."""
    return _with_stats(df, keys, F.avg(value).alias("_a"), F.stddev_samp(value).alias("_b")).withColumn(name, F.try_divide(F.col(value) - F.col("_a"), F.col("_b"))).drop("_a", "_b")


def _with_stats(df: DataFrame, keys: tuple[str, ...], *stats: Column) -> DataFrame:
    """df with statistics of all rows (one row, broadcast) or of its group (a join, so hot groups split)."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*stats)))
    return df.join(df.groupBy(*keys).agg(*stats), list(keys))


def running_total(df: DataFrame, order: str | list[str], value: str, keys: tuple[str, ...] = (), name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(_over(order, keys).rowsBetween(Window.unboundedPreceding, 0)))


def period_delta(df: DataFrame, order: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The period before, the next, the change and the growth; growth from zero is null."""
    w = _over(order, keys)
    out = df.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))
    return out.withColumn("delta", F.col(value) - F.col("previous")).withColumn("growth", F.try_divide("delta", "previous"))


def yoy_monthly(df: DataFrame, month: str, value: str) -> DataFrame:
    """Growth on the same month a year before, by a join, as months may be missing."""
    before = df.select(F.add_months(month, 12).alias(month), F.col(value).alias("year_before"))
    return df.join(before, month, "left").withColumn("yoy", F.try_divide(F.col(value) - F.col("year_before"), F.col("year_before")))


def seasonality_index(df: DataFrame, ts: str, value: str) -> DataFrame:
    """By calendar month: its mean monthly total over the mean of all months."""
    months = df.groupBy(period(ts, "month").alias("m")).agg(F.sum(value).alias("v"))
    overall = months.agg(F.avg("v").alias("overall"))
    return months.groupBy(F.month("m").cast("long").alias("month")).agg(F.avg("v").alias("mean")).crossJoin(F.broadcast(overall)).select("month", F.try_divide("mean", "overall").alias("season_index"))


def forecast_trend_seasonal(df: DataFrame, ts: str, value: str, horizon: int) -> DataFrame:
    """The next months by a linear trend of monthly totals times the seasonal index."""
    months = df.groupBy(period(ts, "month").alias("m")).agg(F.sum(value).alias("v"))
    base = months.agg(F.min("m").alias("m0"))
    number = F.months_between("m", "m0").cast("long")
    numbered = months.crossJoin(F.broadcast(base)).withColumn("t", number)
    fit = numbered.agg(F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("intercept"), F.max("t").alias("last"), F.max("m").alias("end"), F.avg("v").alias("overall"))
    season = months.groupBy(F.month("m").alias("cm")).agg(F.avg("v").alias("mean"))
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k")).withColumn("period", F.add_months("end", F.col("k")))
    out = ahead.join(season, F.month("period") == F.col("cm"), "left")
    return out.select("period", ((F.col("intercept") + F.col("slope") * (F.col("last") + F.col("k"))) * F.coalesce(F.try_divide("mean", "overall"), F.lit(1.0))).alias("forecast"))


def holt(df: DataFrame, order: str, value: str, alpha: float, beta: float, horizon: int) -> DataFrame:
    """Double exponential smoothing of a series already aggregated to periods, as a fold over its values."""
    rows = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("v"))
    start = F.struct(F.element_at("v", 1).alias("level"), F.when(F.size("v") > 1, F.element_at("v", 2) - F.element_at("v", 1)).otherwise(0.0).alias("trend"))

    def step(a: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (a["level"] + a["trend"])
        return F.struct(level.alias("level"), (beta * (level - a["level"]) + (1 - beta) * a["trend"]).alias("trend"))

    state = rows.where(F.size("v") > 0).select(F.aggregate(F.slice("v", 2, F.size("v")), start, step).alias("s"))
    return state.select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "s").select("step", (F.col("s.level") + F.col("step") * F.col("s.trend")).alias("forecast"))
