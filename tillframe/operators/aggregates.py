"""Grouping, reshaping and statistics."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranges import interval_join


def aggregate(df: DataFrame, keys: list[str], outputs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(k) for k, c in outputs.items()))


def multi_group(df: DataFrame, keys: list[str], outputs: Mapping[str, Column], subtotals: bool = False) -> DataFrame:
    """Groups by several keys; with subtotals also by each leading part of them, told apart by level."""
    if not subtotals:
        return aggregate(df, keys, outputs)
    return df.rollup(*keys).agg(F.grouping_id().cast("long").alias("level"), *(c.alias(k) for k, c in outputs.items()))


def drill(df: DataFrame, path: list[str], outputs: Mapping[str, Column], level: int, chosen: Mapping[str, object] | None = None) -> DataFrame:
    """The level-th step of a drill-down path, under the values chosen above it."""
    for name, value in (chosen or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    return aggregate(df, path[: level + 1], outputs)


def group_transform(df: DataFrame, keys: list[str], name: str, expression: Column) -> DataFrame:
    """df with a statistic of its group on every row."""
    return df.withColumn(name, expression.over(Window.partitionBy(*keys)))


def group_apply(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """A pandas function of each group; for what expressions can't say, as groups must fit a worker.

    Groups without a bound are divided by a further key, and the partial results merged.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


@F.pandas_udf(DoubleType())
def _weighted_sum(value: pd.Series, weight: pd.Series) -> float:
    return float((value * weight).sum())


@F.pandas_udf(DoubleType())
def _weights(value: pd.Series, weight: pd.Series) -> float:
    return float(weight[value.notna()].sum())


def weighted_mean_udf(df: DataFrame, keys: list[str], value: str, weight: str, part: Column, name: str) -> DataFrame:
    """The same by grouped pandas UDFs, for comparison with the expression: of the parts of each group, then of the group."""
    parts = df.groupBy(*keys, part.alias("_part")).agg(_weighted_sum(value, weight).alias("_s"), _weights(value, weight).alias("_w"))
    return parts.groupBy(*keys).agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias(name))


def pivot(df: DataFrame, rows: list[str], columns: str, values: list[str], outputs: Mapping[str, Column], fill: object = None) -> DataFrame:
    """A column for each listed value (and output, if there are several)."""
    out = df.groupBy(*rows).pivot(columns, values).agg(*(c.alias(k) for k, c in outputs.items()))
    return out if fill is None else out.fillna(fill)


def crosstab(df: DataFrame, a: str, b: str, values: list[str], margins: bool = False) -> DataFrame:
    """Counts of a by b, zero where a pair is missing; margins add an All row and column."""
    out = pivot(df, [a], b, values, {"n": F.count(F.lit(1))}, 0)
    if margins:
        out = out.withColumn("All", sum((F.col(f"`{v}`") for v in values), F.lit(0)))
        total = out.agg(*(F.sum(F.col(f"`{c}`")).alias(c) for c in out.columns[1:])).select(F.lit("All").alias(a), *(F.col(f"`{c}`") for c in out.columns[1:]))
        out = out.unionByName(total)
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], key: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, key, value)


def explode_items(orders: DataFrame, items: str = "items") -> DataFrame:
    """A row per item; an order without items keeps one row of nulls."""
    rest = [c for c in orders.columns if c != items]
    return orders.select(*rest, F.explode_outer(items).alias("item")).select(*rest, "item.*")


def describe_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: count, mean, sample and population deviation, quartiles, skewness, kurtosis, range."""
    from .segments import quantiles

    stats = {
        "n": lambda c: F.count(c).cast("double"), "mean": F.avg, "std_samp": F.stddev_samp, "std_pop": F.stddev_pop, "var_samp": F.var_samp, "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"), "skewness": F.skewness, "kurtosis": F.kurtosis,
    }
    quarters = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    names = ["n", "mean", "std_samp", "std_pop", "var_samp", "min", *quarters, "max", "skewness", "kurtosis"]
    one = df.agg(*(f(F.col(c)).alias(f"{c}__{k}") for c in columns for k, f in stats.items()))
    for c in columns:
        one = one.crossJoin(F.broadcast(quantiles(df, c, {f"{c}__{k}": q for k, q in quarters.items()})))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{k}").alias(k) for k in names)) for c in columns))).alias("s")).select("s.*")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every pair of columns, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*(F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr")) for a, b in pairs))).alias("s")).select("s.*")


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v): the matrix product of the columns' transpose with themselves, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"{a}__{b}").alias("v")) for a, b in pairs))).alias("s")).select("s.*")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices in long form (i, j, v)."""
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def find_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def rate(condition: Column) -> Column:
    """The share of rows for which the condition holds."""
    return F.try_divide(F.sum(F.when(condition, 1).otherwise(0)), F.count(F.lit(1)))


def kpi_margin(df: DataFrame, keys: list[str], revenue: str, cost: str) -> DataFrame:
    sums = df.groupBy(*keys).agg(F.sum(revenue).alias("revenue"), F.sum(cost).alias("cost"))
    return sums.withColumn("profit", F.col("revenue") - F.col("cost")).withColumn("margin", F.try_divide("profit", "revenue"))


def exec_kpis(lines: DataFrame, order: str, customer: str, revenue: str, units: str) -> DataFrame:
    """Revenue, orders, units, average order value, active customers and the share of them that bought again."""
    per_customer = lines.groupBy(customer).agg(F.sum(revenue).alias("r"), F.countDistinct(order).alias("o"), F.sum(units).alias("u"))
    return per_customer.agg(
        F.sum("r").alias("revenue"), F.sum("o").cast("long").alias("orders"), F.sum("u").alias("units"), F.try_divide(F.sum("r"), F.sum("o")).alias("aov"),
        F.count(F.lit(1)).alias("active_customers"), F.try_divide(F.sum(F.when(F.col("o") > 1, 1).otherwise(0)), F.count(F.lit(1))).alias("repeat_rate"),
    )


# ---------------------------------------------------------------- sketches, regression, variants


def daily_sketches(df: DataFrame, ts: str, value: str, keys: tuple[str, ...] = (), precision: int = 16) -> DataFrame:
    """(keys..., day, sketch): what a day's distinct values leave, some 64 KB at most at this precision, mergeable over any days."""
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def distinct_in_spans(sketches: DataFrame, spans: DataFrame, first: str, end: str) -> DataFrame:
    """spans with estimate: how many distinct values the days from first up to end (left out) have together, 0 if none.

    Days meet the spans in an interval join, and sketches are united, so no row of the
    data is read again. The estimate's deviation is 1.04 / sqrt(2 ** precision), 0.4 % at 16.
    """
    at = interval_join(sketches.select("day", "sketch"), spans, "day", first, end)
    found = at.groupBy(*(F.col(c).alias(f"_{c}") for c in spans.columns)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in spans.columns]
    return spans.join(found, same, "left").select(*spans.columns, F.coalesce("estimate", F.lit(0)).cast("long").alias("estimate"))


def regression(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coefficient, std_error, t): least squares of y on xs and a constant, over rows without a null.

    One pass gives the sums of products, as many as the square of the regressors; the
    normal equations are solved by Cholesky's method on the driver. Regressors that depend
    on each other, or fewer rows than terms, are an error.
    """
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([y, *xs]))).dropna()
    c = [F.lit(1.0), *(F.col(f"c{i}") for i in range(1, len(xs) + 1)), F.col("c0")]
    sums = rows.agg(*(F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(len(c)) for j in range(i, len(c)))).first()
    p = len(c) - 1
    if sums.s0_0 is None or sums.s0_0 < p:
        raise ValueError("fewer rows than terms")
    full = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    scale = np.sqrt(np.diag(full))
    scale[scale == 0] = 1
    gram_, right = (full / np.outer(scale, scale))[:p, :p], (full / np.outer(scale, scale))[:p, p]
    try:
        lower = np.linalg.cholesky(gram_)
    except np.linalg.LinAlgError:
        lower = np.zeros((p, p))
    if np.diag(lower).min() < 1e-7:
        raise ValueError("regressors depend on each other")
    inverse = np.linalg.solve(lower.T, np.linalg.solve(lower, np.eye(p)))
    solved = np.linalg.solve(lower.T, np.linalg.solve(lower, right))
    rest = max(0.0, full[p, p] - scale[p] ** 2 * float(solved @ right))
    spread = rest / (sums.s0_0 - p) if sums.s0_0 > p else float("nan")
    b, e = solved * scale[p] / scale[:p], np.sqrt(spread * np.diag(inverse)) / scale[:p]
    out = [(t, float(b[i]), float(e[i]), float(b[i] / e[i]) if e[i] else None) for i, t in enumerate(["constant", *xs])]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, t double")


def properties(df: DataFrame, variant: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., property, kind, n, total): the top-level properties of objects in a VARIANT column, by the type their values have; total adds up numbers.

    Values that are no objects, and null, have none.
    """
    each = df.select(*keys, F.col(variant).alias("_v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.schema_of_variant("value")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    kind = F.when(number, "number").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind))
    return each.where("key is not null").groupBy(*keys, F.col("key").alias("property"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(number, F.try_variant_get("value", "$", "double"))).alias("total"))
