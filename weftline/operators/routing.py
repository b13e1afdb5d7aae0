"""How rows reach the instances of a node.

``None`` leaves rows where they are, ``"shuffle"`` spreads them evenly, a list
of columns brings equal keys together, ``"global"`` gathers in one partition
(for aggregates prefer the global form of :mod:`aggregates`, which combines
before it moves), ``"all"`` gives every instance every row, that is n copies,
and ``"nature"`` spreads by a seeded random number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffle(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def group_by(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    return df.repartition(n, *keys) if n and n > 1 else df.repartition(*keys)


def all_to_one(df: DataFrame) -> DataFrame:
    return df.coalesce(1)


def one_to_all(df: DataFrame, n: int, column: str = "inst") -> DataFrame:
    """n copies of each row, numbered; rows are copied where they are, without a shuffle."""
    return df.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(column))


def nature(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.repartition(n, F.rand(seed))


def route(df: DataFrame, grouping, n: int) -> DataFrame:
    """Apply a node's grouping of one input."""
    if grouping is None:
        return df
    if grouping == "shuffle":
        return shuffle(df, n)
    if grouping == "global":
        return all_to_one(df)
    if grouping == "all":
        return one_to_all(df, n)
    if grouping == "nature":
        return nature(df, n)
    return group_by(df, list(grouping), n)
