"""Latency tables per node, instance and iteration, and timers."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators.ordered import exact_percentiles


class Timer:
    """Wall time of a block: ``with Timer() as t: ...; t.seconds``."""

    def __enter__(self):
        self._t = time.perf_counter()
        return self

    def __exit__(self, *_):
        self.seconds = time.perf_counter() - self._t


@contextmanager
def timed(name: str, log: list):
    with Timer() as t:
        yield
    log.append((name, t.seconds))


def instrument(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row count of a node's output, observed as it runs and without a pass of its own."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o


def latency(df: DataFrame, keys: list[str], seconds: str = "iteration_secs", prefix: str = "") -> DataFrame:
    """total_count, total_secs, avg, min, p50, p95, max of each group; null, NaN and negative times are left out.

    The percentiles are exact and spread like a sort: no task holds a group's values.
    """
    x = F.col(seconds)
    ok = df.where(x.isNotNull() & ~F.isnan(x) & (x >= 0))
    sums = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}total_count"),
        F.sum(x).alias(f"{prefix}total_secs"),
        F.avg(x).alias(f"{prefix}avg_secs"),
        F.min(x).alias(f"{prefix}min_secs"),
        F.max(x).alias(f"{prefix}max_secs"),
    )
    mid = exact_percentiles(ok, keys, seconds, {f"{prefix}p50_secs": 0.5, f"{prefix}p95_secs": 0.95}).withColumnsRenamed({k: f"_{k}" for k in keys})
    both = sums.join(mid, [sums[k].eqNullSafe(mid[f"_{k}"]) for k in keys])
    order = ["total_count", "total_secs", "avg_secs", "min_secs", "p50_secs", "p95_secs", "max_secs"]
    return both.select(*(sums[k] for k in keys), *(f"{prefix}{c}" for c in order))


def instance_summary(df: DataFrame, seconds: str = "iteration_secs") -> DataFrame:
    return latency(df, ["pe_id", "rank"], seconds)


def iteration_latency(df: DataFrame, seconds: str = "iteration_secs") -> DataFrame:
    return latency(df, ["pe_id", "rank", "instance_id"], seconds)


def iteration_summary(df: DataFrame, seconds: str = "iteration_secs") -> DataFrame:
    """Each iteration with its instance's p50, p95 and maximum."""
    keys = ["pe_id", "rank", "instance_id"]
    s = latency(df, keys, seconds).select(*(F.col(k).alias(f"_{k}") for k in keys), "p50_secs", "p95_secs", "max_secs")
    return df.join(s, [df[k].eqNullSafe(s[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))


def pe_summary(df: DataFrame, seconds: str = "iteration_secs") -> DataFrame:
    """Latency of each node with its ranks, in numeric order, joined by ';'."""
    ranks = df.where("rank is not null").groupBy("pe_id").agg(F.array_sort(F.collect_set("rank")).alias("r"))
    r = ranks.select(F.col("pe_id").alias("_pe"), F.size("r").alias("rank_count"), F.array_join(F.transform("r", lambda x: x.cast("string")), ";").alias("ranks"))
    s = latency(df, ["pe_id"], seconds)
    return s.join(r, s["pe_id"].eqNullSafe(r["_pe"]), "left").drop("_pe").withColumns({"rank_count": F.coalesce("rank_count", F.lit(0)), "ranks": F.coalesce("ranks", F.lit(""))})


def interarrival(df: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Mean seconds between arrivals of each key; keys with one arrival are left out.

    The gaps of a key add up to its last arrival less its first, so nothing is
    sorted; ``order`` is taken as the order of arrival and need not be that of time.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    place = F.struct(*order)
    out = df.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.min_by(t, place).alias("a"), F.max_by(t, place).alias("z"), F.count(F.lit(1)).alias("n"))
    return out.where("n > 1").select(*keys, ((F.col("z") - F.col("a")) / 1e6 / (F.col("n") - 1)).alias("avg_gap"))


def process_time(log: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Mean processing seconds of each node."""
    return log.where(F.col(end) >= F.col(start)).groupBy(*keys).agg(F.avg(F.col(end) - F.col(start)).alias("avg_secs"))


def read_timings(spark: SparkSession, pattern: str, run_id: str, iterations: bool = False) -> DataFrame:
    """Rows of one run's timing files, whose names end in ``_run<run id>.csv``; a folder is read with all files in it."""
    kind = "pe_id string, rank string, instance_id string, iteration_index bigint, iteration_secs double" if iterations else "pe_id string, rank string, count bigint, total_secs double, avg_secs double"
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    mine = name.endswith(f"_run{safe_name(run_id)}.csv") & (F.contains(name, F.lit("_iterations_")) == F.lit(iterations))
    return spark.read.schema(kind).option("header", True).csv(pattern).withColumn("_mine", mine).where("_mine").drop("_mine")


def write_csv(df: DataFrame, path: str, files: int = 1) -> None:
    df.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def write_timings(log: list[dict], folder: str, prefix: str, run_id: str) -> list[str]:
    """A timing file for each output of :meth:`Graph.run_timed`, named as :func:`read_timings` expects; rank is 0, the run's driver."""
    import csv
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    made = []
    for row in log:
        path = Path(folder) / f"{prefix}_{safe_name(row['pe_id'])}_{safe_name(row['port'])}_rank0_run{safe_name(run_id)}.csv"
        with open(path, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(["pe_id", "rank", "count", "total_secs", "avg_secs"])
            w.writerow([row["pe_id"], 0, row["count"], row["total_secs"], row["avg_secs"]])
        made.append(str(path))
    return made
