"""Filters, conversions, joins and set operations on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import asof, interval_join


def net(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return F.col(price) * (1 - F.col(discount))


def with_revenue(lines: DataFrame, price: str = "l_extendedprice", discount: str = "l_discount", name: str = "revenue") -> DataFrame:
    return lines.withColumn(name, net(price, discount))


def predicate(filters: Mapping[str, object]) -> Column:
    """One condition from {column: value, (low, high) or a set}; None in a range leaves that end open."""
    parts: list[Column] = []
    for name, want in filters.items():
        c = F.col(name)
        if isinstance(want, tuple):
            low, high = want
            parts += [c >= F.lit(low)] if low is not None else []
            parts += [c <= F.lit(high)] if high is not None else []
        elif isinstance(want, set | list | frozenset):
            parts.append(c.isin(sorted(want)))
        else:
            parts.append(c.isNull() if want is None else c == F.lit(want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    return df.where(predicate(filters))


def convert(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns of schema, cast where they can be and null where they can't."""
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def merge(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", null_equal: bool = False) -> DataFrame:
    """Equi-join on columns of one name; null_equal matches null keys with each other, as a data-frame merge does."""
    keys = [on] if isinstance(on, str) else list(on)
    if not null_equal:
        return left.join(right, keys, how)
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    if how in ("left_semi", "left_anti"):
        return a.join(b, same, how)
    both = a.join(b, same, how)
    key = {k: F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys}
    return both.select(*key.values(), *(f"a.{c}" for c in left.columns if c not in keys), *(f"b.{c}" for c in right.columns if c not in keys))


def fk_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose key, if any, no parent has."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def without_match(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of df that other doesn't mention."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def with_match(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def band(df: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """df joined to the band with low <= value < high; a few bands are broadcast, behind a count, many are joined by bins."""
    return interval_join(df, bands, value, low, high, how="left")


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """As-of join: the values of right's last row at or before each left row, by keys."""
    return asof(left, right, keys, left_ts, right_ts, values)


def star(lines: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Lines with their order, customer, nation and region; nation and region are small by nature."""
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    buyers = customer.join(F.broadcast(places), customer.c_nationkey == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(buyers, F.col("o_custkey") == F.col("c_custkey"))


def append_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rest, first)


def hinted(df: DataFrame, strategy: str) -> DataFrame:
    """df with a join hint: broadcast, merge or shuffle_hash; for measurements."""
    return df.hint(strategy)


def search(df: DataFrame, columns: Iterable[str], query: str) -> DataFrame:
    """Rows in which any of the columns holds the query, whatever its case."""
    needle = F.lower(F.lit(query))
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c).cast("string")), needle) for c in columns)))


def page(df: DataFrame, order: list[str], n: int, after: tuple | None = None) -> DataFrame:
    """The next n rows in a total ascending order, after the given values of the last page."""
    if after is not None:
        later = F.lit(False)
        for k in reversed(range(len(order))):
            c, v = F.col(order[k]), F.lit(after[k])
            later = (c > v) | ((c == v) & later)
        df = df.where(later)
    return df.orderBy(*(F.asc_nulls_last(c) for c in order)).limit(n)


def hot_keys(df: DataFrame, on: list[str], share: float) -> DataFrame:
    """The keys, null ones too, of more than that share of df's rows: at most 1 / share of them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    rows = counts.where(F.col("_n") > share * total).drop("_n").collect()
    return df.sparkSession.createDataFrame(rows, counts.drop("_n").schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16, share: float = 0.05) -> DataFrame:
    """Equi-join (inner or left) in which a hot key of left is dealt over salts, and its rows of right are there for each.

    For joins whose sides are both too large to broadcast; only rows of right whose key
    is hot are repeated. Null keys match nothing, and are dealt out as well.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    hot = hot_keys(left, on, share).select(*(F.col(k).alias(f"_{k}") for k in on), F.lit(True).alias("_hot"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on))
    flagged = lambda df: df.join(F.broadcast(hot), same, "left").drop(*(f"_{k}" for k in on))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = flagged(left).withColumn("_salt", salt).drop("_hot")
    b = flagged(right).withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b, [*on, "_salt"], how).drop("_salt")
