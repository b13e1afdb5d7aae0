"""Count, sum, min, max, average and deviation in three forms.

* one-shot: one row, for all rows or for each key;
* partial and final: mergeable states that :func:`merge` puts together, equal to
  one-shot over all rows whatever the parts;
* continuous: the state after every row, per key or over a total order.

Empty input: count and sum give 0, min and max null, average and deviation no
row (:func:`average_row`) or null; a deviation of one value is null. Null values
are left out of all but ``count()``. ``floor_at_zero`` makes a maximum start at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def count() -> Column:
    return F.count(F.lit(1))


def total(column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def smallest(column) -> Column:
    return F.min(column)


def largest(column, floor_at_zero: bool = False) -> Column:
    return F.greatest(F.lit(0.0), F.max(column)) if floor_at_zero else F.max(column)


def one_shot(df: DataFrame, aggregates: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    cols = [c.alias(k) for k, c in aggregates.items()]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def partial(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """State (n, s, m2, lo, hi) of one column for each key: n values, sum, squared deviations from their mean, extremes."""
    x = F.col(column)
    m2 = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("s"), m2.alias("m2"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def merge(states: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One state from many; the order of merging does not matter.

    Squared deviations are moved to the common mean state by state, never as a
    difference of large sums, so values far from 0 keep their digits.
    """
    keys = list(keys)
    cols = [F.sum("n").cast("bigint").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    whole = states.groupBy(*keys).agg(*cols) if keys else states.agg(*cols)
    mean = whole.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("s") / F.nullif("n", F.lit(0))).alias("_mean"))
    same = [states[k].eqNullSafe(mean[f"_{k}"]) for k in keys]
    beside = states.join(mean, same) if keys else states.join(F.broadcast(mean))  # one row
    moved = F.col("m2") + F.col("n") * F.pow(F.try_divide("s", "n") - F.col("_mean"), F.lit(2))
    m2 = F.sum(moved).alias("m2")
    parts = beside.groupBy(*keys).agg(m2) if keys else beside.agg(m2)
    if not keys:
        return whole.join(F.broadcast(parts)).select("n", "s", "m2", "lo", "hi")
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), "m2")
    return whole.join(parts, [whole[k].eqNullSafe(parts[f"_{k}"]) for k in keys]).select(*keys, "n", "s", "m2", "lo", "hi")


def final(states: DataFrame, *keep: str) -> DataFrame:
    """count, sum, avg, min, max and sample deviation of states; empty states are dropped."""
    n, s = F.col("n"), F.col("s")
    return states.where("n > 0").select(
        *keep, n.alias("count"), s.alias("sum"), (s / n).alias("avg"), F.col("lo").alias("min"), F.col("hi").alias("max"),
        F.sqrt(F.try_divide(F.col("m2"), n - 1)).alias("stddev"),
    )


def average_row(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """(avg, count, sum); no row without values."""
    return final(merge(partial(df, column, list(keys)), list(keys)), *keys).select(*keys, "avg", "count", "sum")


def deviation_row(df: DataFrame, column: str) -> DataFrame:
    """(stddev, count, sum, sum of squares); the deviation by Spark's stable merge of moments."""
    x = F.col(column)
    return df.agg(F.stddev_samp(x).alias("stddev"), F.count(x).alias("count"), F.sum(x).alias("sum"), F.sum(x * x).alias("squares"))


def continuous(df: DataFrame, order: list[str], aggregates: dict[str, tuple[str, str]], keys: list[str] = ()) -> DataFrame:
    """State after every row, in the order given, over all rows or per key: {name: (sum|count|min|max, column)}.

    Rows are range-sorted over all tasks (:mod:`ordered`), so no task holds all rows, or all of a key's.
    """
    return ordered.running(df, order, aggregates, list(keys))
