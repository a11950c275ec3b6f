"""Column helpers: cleaning, safe arithmetic, banding, arrays, table functions."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def clean_text(c: Column) -> Column:
    """Trimmed, inner white space single, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def bands(c: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[k] for edges[k-1] <= c < edges[k]; one more label than edges."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c < edge, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def bands_udf(edges: list[float], labels: list[str]):
    """bands() as a vectorised Python function, to compare the two; null has no band in either."""

    def banded(c: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, c.to_numpy(), "right")
        return pd.Series(np.array(labels, object)[at]).where(c.notna(), None)

    return F.pandas_udf(banded, "string")


def weekday_sunday0(c: Column) -> Column:
    return (F.dayofweek(c) - 1).cast("long")


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class _Calendar:
    def eval(self, start: datetime.date, end: datetime.date):
        while start <= end:
            yield start, start.weekday() >= 5
            start += datetime.timedelta(days=1)


def calendar(start: datetime.date, end: datetime.date) -> DataFrame:
    """Every day of a range, from a table function."""
    return F.udtf(_Calendar, returnType="date: date, weekend: boolean")(F.lit(start), F.lit(end))


def calendar_of(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with a row for each day from start to end, by a lateral join with the table function; spans without a start or end have none."""
    spans = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    days = F.udtf(_Calendar, returnType="date: date, weekend: boolean")(F.col(start).outer(), F.col(end).outer())
    return spans.lateralJoin(days)


class _Runs:
    """A table function over a table dealt out by key and sorted by date: its runs, of dates at most so many days apart."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, day: AnalyzeArgument, gap: AnalyzeArgument, undated: AnalyzeArgument) -> AnalyzeResult:
        """The key keeps its name and type; a column that isn't there, or is no date, is an error before anything runs."""
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for a in (key, day):
            if a.value not in kinds:
                raise ValueError(f"the table has no column {a.value!r}")
        if not isinstance(kinds[day.value], T.DateType):
            raise ValueError(f"{day.value} is {kinds[day.value].simpleString()}, not a date")
        if not isinstance(gap.value, int) or gap.value < 0:
            raise ValueError("gap is a number of days")
        out = T.StructType().add(key.value, kinds[key.value]).add("run", T.LongType()).add("first_day", T.DateType()).add("last_day", T.DateType()).add("n", T.LongType())
        return AnalyzeResult(schema=out)

    def __init__(self):
        self.key, self.run, self.first, self.last, self.n = None, 0, None, None, 0

    def eval(self, row, key: str, day: str, gap: int, undated: bool):
        self.key, at = row[key], row[day]
        if at is None and not undated:
            return
        if self.n and (at is None or self.last is None or (at - self.last).days > gap):
            yield self._found()
            self.first, self.n = None, 0
        if not self.n:
            self.run += 1
            self.first = at
        self.last, self.n = at, self.n + 1

    def terminate(self):
        if self.n:
            yield self._found()

    def _found(self):
        return self.key, self.run, self.first, self.last, self.n


def runs(df: DataFrame, key: str, day: str, gap: int, undated: bool = False) -> DataFrame:
    """(key, run, first_day, last_day, n): runs of a key's dates, each at most gap days after the one before.

    A key's rows stream through one task in order of date, which holds a few numbers;
    rows without a date count for nothing, or with undated are each a run, after the
    others. Those without a key are a key.
    """
    table = df.select(key, day).asTable().partitionBy(key).orderBy(F.col(day).asc_nulls_last())
    return F.udtf(_Runs)(table, F.lit(key), F.lit(day), F.lit(gap), F.lit(undated))
