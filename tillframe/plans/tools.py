"""Plans as text, timings, settings and chart specifications."""

from __future__ import annotations

import contextlib
import io
import logging
import os
import statistics
import time
from collections.abc import Callable, Mapping

from pydantic import BaseModel, Field
from pyspark.sql import DataFrame, SparkSession


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def get_logger(stage: str) -> logging.Logger:
    return logging.getLogger(f"tillframe.{stage}")


#: The settings that come with the package.
SETTINGS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "settings.yaml")


class Settings(BaseModel):
    """Validated settings of a run."""

    app_name: str = "tillframe"
    shuffle_partitions: int = Field(200, gt=0)
    max_partition_mb: int = Field(128, gt=0)
    adaptive: bool = True
    time_zone: str = "UTC"
    abc_a: float = Field(0.8, gt=0, lt=1)
    abc_b: float = Field(0.95, gt=0, le=1)
    refresh: str = "5 seconds"

    @classmethod
    def load(cls, path: str, env: Mapping[str, str] | None = None) -> Settings:
        """From a YAML file; variables TILLFRAME_<NAME> go before it."""
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
        for name in cls.model_fields:
            if (v := (env or {}).get(f"TILLFRAME_{name.upper()}")) is not None:
                values[name] = v
        return cls(**values)

    def apply(self, spark: SparkSession) -> None:
        for k, v in {"spark.sql.shuffle.partitions": self.shuffle_partitions, "spark.sql.files.maxPartitionBytes": f"{self.max_partition_mb}m", "spark.sql.adaptive.enabled": str(self.adaptive).lower(), "spark.sql.session.timeZone": self.time_zone}.items():
            spark.conf.set(k, v)


def bench(spark: SparkSession, cases: Mapping[str, Mapping[str, Callable[[], object]]], runs: int = 5, warmup: int = 1) -> DataFrame:
    """(operation, engine, median_s, spread_s, runs, jvm_mb, python_mb); a DataFrame that a case returns is written to nowhere.

    jvm_mb is the largest peak of the driver's heap and other pools, python_mb the growth of
    this process at its peak. In local mode that is all the memory but that of Python workers.
    """
    rows = []
    for operation, engines in cases.items():
        for engine, fn in engines.items():
            took, jvm, python = [], 0.0, 0.0
            for k in range(warmup + runs):
                peaks = _peaks(spark)
                began = time.perf_counter()
                if isinstance(out := fn(), DataFrame):
                    out.write.format("noop").mode("overwrite").save()
                took += [time.perf_counter() - began] if k >= warmup else []
                jvm, python = map(max, (jvm, python), peaks())
            rows.append((operation, engine, statistics.median(took), max(took) - min(took), runs, jvm, python))
    return spark.createDataFrame(rows, "operation string, engine string, median_s double, spread_s double, runs int, jvm_mb double, python_mb double")


def _peaks(spark: SparkSession) -> Callable[[], tuple[float, float]]:
    """Start to watch memory; the result gives the JVM's and this process's peaks in MB since then. Linux alone tells the latter."""

    def resident(line: str) -> float:
        try:
            with open("/proc/self/status", encoding="ascii") as f:
                return next(int(x.split()[1]) / 1024 for x in f if x.startswith(line))
        except (OSError, StopIteration):
            return 0.0

    spark._jvm.System.gc()
    pools = list(spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans())
    for pool in pools:
        pool.resetPeakUsage()
    with contextlib.suppress(OSError), open("/proc/self/clear_refs", "w", encoding="ascii") as f:
        f.write("5")
    before = resident("VmRSS")
    return lambda: (sum(p.getPeakUsage().getUsed() for p in pools) / 2**20, max(0.0, resident("VmHWM") - before))


def chart_spec(df: DataFrame, x: str, y: str, question: str, series: str | None = None, kind: str = "line") -> dict:
    """What a chart shows and the question it answers; drawing it is left to the caller."""
    missing = [c for c in (x, y, series) if c and c not in df.columns]
    if missing or not question:
        raise ValueError(f"no such columns: {missing}" if missing else "a chart answers a question")
    return {"kind": kind, "x": x, "y": y, "series": series, "question": question, "data": df}
