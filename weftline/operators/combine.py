"""Operators of several inputs: products, lock-step zips, barriers, correlations.

Order is explicit everywhere: rows pair up by their rank in the order columns,
never by arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair, as asked for; left columns come first. The result has |left| * |right| rows by definition."""
    return left.crossJoin(right)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def square(a: Column) -> Column:
    return a * a


def ranked(df: DataFrame, order: list[str], keys: list[str] = (), column: str = "rn") -> DataFrame:
    """Position in the order, from 1, per key or over all rows; neither puts one key's rows in one task."""
    if keys:
        return ordered.running(df.withColumn("_one", F.lit(1)), order, {column: ("count", "_one")}, list(keys)).drop("_one")
    placed, _ = ordered.with_position(df, order, column)
    return placed.withColumn(column, F.col(column) + 1)


def zip_join(left: DataFrame, right: DataFrame, order: list[str], keys: list[str], lcols: dict[str, str], rcols: dict[str, str]) -> DataFrame:
    """i-th left row with i-th right row of each key; rows beyond the shorter side are dropped.

    ``lcols`` and ``rcols`` map result names to columns, so clashing names are no matter.
    """
    a = ranked(left, order, keys).select(*keys, "rn", *(F.col(c).alias(k) for k, c in lcols.items()))
    b = ranked(right, order, keys).select(*keys, "rn", *(F.col(c).alias(k) for k, c in rcols.items()))
    return a.join(b, [*keys, "rn"])


def barrier(df: DataFrame, stream: str, streams: list, order: list[str], value: Column, folds: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """i-th values of n streams folded together, only where all n have arrived."""
    r = ranked(df.where(F.col(stream).isin(*streams)), order, [stream])
    out = r.groupBy("rn").agg(*(f(value).alias(k) for k, f in folds.items()), F.count(F.lit(1)).alias("_k"))
    return out.where(F.col("_k") == len(streams)).drop("_k")


def batched_correlation(left: DataFrame, right: DataFrame, order: list[str], value: str, batch: int) -> DataFrame:
    """Pearson r of every full batch of ``batch`` zipped pairs; a partial last batch is dropped."""
    a = ranked(left, order).select("rn", F.col(value).alias("x"))
    b = ranked(right, order).select("rn", F.col(value).alias("y"))
    pairs = a.join(b, "rn").withColumn("batch", F.floor((F.col("rn") - 1) / batch).cast("bigint"))
    return pairs.groupBy("batch").agg(F.corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == batch).drop("_n")


def correlations(df: DataFrame, stream: str, order: list[str], value: str, batch: int | None = None) -> DataFrame:
    """(i, j[, batch], rho) of all pairs i < j of streams, rank by rank, of full batches where ``batch`` is given.

    The join is on the rank, where each stream has one row: as many pairs a rank
    as pairs of streams, which is what a correlation matrix is.
    """
    r = ranked(df, order, [stream]).select(F.col(stream).alias("t"), "rn", F.col(value).alias("v"))
    x, y = r.select(F.col("t").alias("i"), "rn", F.col("v").alias("x")), r.select(F.col("t").alias("j"), "rn", F.col("v").alias("y"))
    pairs = x.join(y, "rn").where("i < j")
    if batch is None:
        return pairs.groupBy("i", "j").agg(F.corr("x", "y").alias("rho"))
    pairs = pairs.withColumn("batch", F.floor((F.col("rn") - 1) / batch).cast("bigint"))
    return pairs.groupBy("i", "j", "batch").agg(F.corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == batch).drop("_n")


def complete_matrices(cells: DataFrame, streams: int) -> DataFrame:
    """Only cells of batches in which all n(n-1)/2 pairs are there."""
    full = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == streams * (streams - 1) // 2).select("batch")
    return cells.join(full, "batch", "left_semi")


def matrix_rows(cells: DataFrame) -> DataFrame:
    """One row for each batch: its cells as a sorted array of (i, j, rho)."""
    return cells.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "j", "rho"))).alias("cells"))


def threshold(cells: DataFrame, least: float) -> DataFrame:
    """Cells below the threshold become 0: a weighted edge list."""
    return cells.withColumn("rho", F.when(F.col("rho") < least, F.lit(0.0)).otherwise(F.col("rho")))


def communication_time(log: DataFrame, pe: str = "pe", method: str = "method", start: str = "start", end: str = "end", data: str = "data", within: list[str] = ()) -> DataFrame:
    """Longest time between a write and a read of the same data, for each (writer, reader): seconds and number of data.

    The time of two calls is the later end less the later start. Its greatest value
    over all pairs needs no pairs: a call meets, of each node on the other side, only
    that node's earliest start. Reads of data nobody wrote have a null writer and
    their own time. Calls without start, end or data are left out; ``within`` are
    columns, as a run's id, inside which data are the same.
    """
    key = [f"_k{i}" for i in range(len(within) + 1)]
    s, e = F.col(start), F.col(end)
    calls = log.select(*(F.col(c).alias(k) for c, k in zip([*within, data], key, strict=True)), F.col(pe).alias("_pe"), F.col(method).alias("_m"), s.alias("_s"), e.alias("_e"))
    calls = calls.dropna(subset=[*key, "_s", "_e"])

    def side(kind: str, other: str, mine: str, its: str, how: str) -> DataFrame:
        first = calls.where(F.col("_m") == other).groupBy(*key, F.col("_pe").alias(its)).agg(F.min("_s").alias("_f"))
        met = calls.where(F.col("_m") == kind).withColumnRenamed("_pe", mine).join(first, key, how)
        return met.select(*key, "writer", "reader", (F.col("_e") - F.greatest("_s", "_f")).alias("_t"))

    both = side("read", "write", "reader", "writer", "left").unionByName(side("write", "read", "writer", "reader", "inner"))
    each = both.groupBy(*key, "writer", "reader").agg(F.max("_t").alias("_t"))
    return each.groupBy("writer", "reader").agg(F.max("_t").alias("seconds"), F.count(F.lit(1)).alias("data"))


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, until: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Bounded feedback: the output of each round is the next round's input, written between rounds."""
    from ..scratch import Scratch

    work = Scratch(state.sparkSession, "feedback")
    for i in range(rounds):
        old, (state, _) = state, work.write(step(state, i))
        work.drop(old)
        if until is not None and until(state):
            break
    return state
