"""Data quality: schema and row validation, quarantine, null strategies, downcasting, encoding."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import discard, written

log = logging.getLogger("tillframe.quality")


def validate_schema(df: DataFrame, schema: T.StructType) -> list[str]:
    """What differs from the declared schema: missing, unexpected and wrongly typed columns."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in schema.fields}
    out = [f"missing: {c}" for c in want if c not in have] + [f"unexpected: {c}" for c in have if c not in want]
    return out + [f"type of {c}: {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c].simpleString() != want[c].simpleString()]


def schema_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, violation, rows): where df, as read, departs from a declared schema, and how many rows that concerns, in one pass.

    missing and unexpected columns concern all rows; a column of another type those whose
    value is not the same in the declared one; null those without a value in a column
    declared without nulls. Types that differ and fit every row have 0.
    """
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f for f in schema.fields}
    every, found = F.count(F.lit(1)), []
    for name, field in want.items():
        if name not in have:
            found.append((name, "missing", every))
            continue
        c = F.col(f"`{name}`")
        if have[name].simpleString() != field.dataType.simpleString():
            there = c.try_cast(field.dataType)
            same = there.isNotNull() & there.try_cast(have[name]).eqNullSafe(c)
            found.append((name, f"{have[name].simpleString()}, not {field.dataType.simpleString()}", F.count(F.when(c.isNotNull() & ~same, 1))))
        if not field.nullable:
            found.append((name, "null", F.count(F.when(c.isNull(), 1))))
    found += [(name, "unexpected", every) for name in have if name not in want]
    rows = F.array(*(F.struct(F.lit(name).alias("column"), F.lit(what).alias("violation"), n.alias("rows")) for name, what, n in found))
    if not found:
        return df.sparkSession.createDataFrame([], "column string, violation string, rows long")
    out = df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out.where("violation <> 'null' or rows > 0")


def with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df with reasons: the names of the rules a row breaks. A rule that is null counts as broken."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))))


def validate_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with their reasons); both lazy, over one scan each."""
    marked = with_reasons(df, rules)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def dq_summary(rejected: DataFrame) -> DataFrame:
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Drop:
    """Rows without the value go."""


@dataclass(frozen=True)
class Impute:
    """mean, median, mode or a constant takes its place."""

    how: str = "mean"
    value: object = None


@dataclass(frozen=True)
class Flag:
    """The value stays null, and a column <name>_missing says so."""


def handle_nulls(df: DataFrame, strategy: Mapping[str, Drop | Impute | Flag]) -> DataFrame:
    """The stated strategy for each column; NaN counts as null. Statistics are one broadcast row, medians exact."""
    from .segments import quantiles

    kinds = dict(df.dtypes)
    for c in strategy:
        if kinds[c] in ("double", "float"):
            df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    df = df.dropna(subset=[c for c, s in strategy.items() if isinstance(s, Drop)]) if any(isinstance(s, Drop) for s in strategy.values()) else df
    how = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}
    stats = {c: s.how for c, s in strategy.items() if isinstance(s, Impute) and s.how != "constant"}
    rows = [df.agg(*(how[h](c).alias(f"_{c}") for c, h in stats.items() if h in how))] if set(stats.values()) & set(how) else []
    for row in rows + [quantiles(df, c, {f"_{c}": 0.5}) for c, h in stats.items() if h == "median"]:
        df = df.crossJoin(F.broadcast(row))
    for c, s in strategy.items():
        if isinstance(s, Impute):
            df = df.withColumn(c, F.coalesce(F.col(c), (F.lit(s.value) if s.how == "constant" else F.col(f"_{c}")).cast(kinds[c])))
        elif isinstance(s, Flag):
            df = df.withColumn(f"{c}_missing", F.col(c).isNull())
    return df.drop(*(f"_{c}" for c in stats))


_WHOLE = [("tinyint", -(2**7), 2**7 - 1, 1), ("smallint", -(2**15), 2**15 - 1, 2), ("int", -(2**31), 2**31 - 1, 4), ("bigint", -(2**63), 2**63 - 1, 8)]


def narrowest(df: DataFrame) -> DataFrame:
    """(column, was, now, bytes_saved) for each column of whole numbers that a narrower type would hold, from its least and greatest value."""
    whole = [(c, k) for c, k in df.dtypes if k in ("bigint", "int", "smallint")]
    if not whole:
        return df.sparkSession.createDataFrame([], "column string, was string, now string, bytes_saved int")
    width = {k: b for k, _, _, b in _WHOLE}
    ends = []
    for c, kind in whole:
        low, high = F.coalesce(F.min(c), F.lit(0)), F.coalesce(F.max(c), F.lit(0))
        now = F.lit(kind)
        for k, a, b, n in reversed([x for x in _WHOLE if x[3] < width[kind]]):
            now = F.when((low >= a) & (high <= b), k).otherwise(now)
        ends.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("was"), now.alias("now")))
    found = df.agg(F.array(*ends).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("was <> now")
    bytes_of = F.create_map(*(F.lit(x) for k, n in width.items() for x in (k, n)))
    return found.withColumn("bytes_saved", (bytes_of[F.col("was")] - bytes_of[F.col("now")]).cast("int"))


def downcast(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with whole numbers in the narrowest type that holds them, and what narrowest() says of it."""
    report = narrowest(df)
    to = {r["column"]: r.now for r in report.collect()}  # a row for each column at most
    return df.select(*(F.col(f"`{c}`").cast(to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in df.columns)), report


def stored_bytes(df: DataFrame) -> int:
    """The bytes df takes as Parquet: written to the shared folder, measured and deleted."""
    table = written(df, "measured")
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_to)
    size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    discard(table)
    return size


def dictionary_encode(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(df with <column>_code, the ordered dictionary). Codes count from 0 by value; null has none."""
    from .segments import running_over_all

    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = running_over_all(values, [F.asc(column)], None, "_n").select(column, (F.col("_n") - 1).alias(f"{column}_code"))
    return df.join(codes, column, "left"), codes


def logged(df: DataFrame, stage: str, accepted: Column) -> tuple[DataFrame, Observation]:
    """df, watched: once an action has run, the observation holds rows in, accepted and rejected."""
    seen = Observation(stage)
    n = F.sum(F.when(accepted, 1).otherwise(0)).cast("long")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), n.alias("accepted"), (F.count(F.lit(1)) - n).alias("rejected")), seen


def report(stage: str, seen: Observation) -> None:
    log.info("stage=%s %s", stage, " ".join(f"{k}={v}" for k, v in seen.get.items()))
