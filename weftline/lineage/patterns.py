"""Derivation patterns: which inputs an output was derived from.

Each takes rows in an explicit order per instance key and adds an array of ids
of the inputs (or, where an output stands for a group, gives one row for it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running

#: Rows of a key that one window runs over.
BLOCK = 100_000


def single_invocation(df: DataFrame, ident: str, column: str = "derived_from") -> DataFrame:
    """Stateless: an output derives from its own invocation's input."""
    return df.withColumn(column, F.array(F.col(ident)))


force_stateless = single_invocation


def slide(df: DataFrame, keys: list[str], order: list[str], ident: str, width: int, column: str = "derived_from") -> DataFrame:
    """An output derives from the last ``width`` inputs.

    Rows are numbered per key over all tasks and windows run inside blocks of BLOCK
    numbers, each with the ``width`` - 1 rows before it, so a hot key is spread.
    """
    block = max(BLOCK, width)
    marked = running(df.withColumn("_one", F.lit(1)), order, {"_rn": ("count", "_one")}, keys).drop("_one")
    own = F.floor((F.col("_rn") - 1) / block)
    nxt = F.floor((F.col("_rn") + width - 2) / block)
    copies = marked.withColumn("_own", own).withColumn("_block", F.explode(F.array_distinct(F.array(own, nxt))))
    w = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-(width - 1), 0)
    return copies.withColumn(column, F.collect_list(ident).over(w)).where("_block = _own").drop("_rn", "_own", "_block")


def emission_group(df: DataFrame, keys: list[str], order: list[str], emits: Column, column: str = "grp") -> DataFrame:
    """Number of the emission that takes up each input: inputs since the last emission belong to the next one."""
    marked = df.withColumn("_e", F.coalesce(emits, F.lit(False)).cast("int"))
    run = running(marked, order, {column: ("sum", "_e")}, keys)
    return run.withColumn(column, (F.col(column) - F.col("_e")).cast("bigint"))


def accumulate(df: DataFrame, keys: list[str], order: list[str], ident: str, emits: Column) -> DataFrame:
    """One row for each emission: key, ``grp``, number of inputs, first and last input.

    The inputs themselves are the rows of :func:`emission_group` with that number;
    they are not gathered in one array, for a key may hold a third of all rows.
    """
    g = emission_group(df, keys, order, emits)
    return (
        g.groupBy(*keys, "grp")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.max("_e").alias("_done"))
        .where("_done = 1")
        .drop("_done")
    )


def n_by_one(streams: dict[str, DataFrame], keys: list[str], order: list[str], ident: str, column: str = "derived_from") -> DataFrame:
    """Lock-step over ports: the i-th output derives from the i-th input of every port."""
    from ..operators.combine import ranked

    parts = [ranked(df, order, keys).select(*keys, "rn", F.lit(p).alias("port"), F.col(ident).alias("id")) for p, df in streams.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys, "rn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("port", "id")))).alias(column)).where(F.size(column) == len(streams))


def grouped(df: DataFrame, group: list[str], order: list[str], ident: str, column: str = "previous") -> DataFrame:
    """State by grouping key: an output derives from its input and the state its key had, named by the input before."""
    two = slide(df, group, order, ident, 2, "_two")
    return two.withColumn(column, F.when(F.size("_two") > 1, F.element_at("_two", 1))).drop("_two")


def stateful_output(df: DataFrame, keys: list[str], order: list[str], ident: str, writes_state: Column, column: str = "state_id") -> DataFrame:
    """An output derives from the state last written before it, whose place among its key's states is counted over all tasks."""
    marked = running(df.withColumn("_w", F.coalesce(writes_state, F.lit(False)).cast("int")), order, {"_upto": ("sum", "_w")}, keys)
    states = marked.where("_w = 1").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_upto").alias("_state"), F.col(ident).alias(column))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return marked.join(states, [*same, F.col("_upto") - F.col("_w") == F.col("_state")], "left").drop("_w", "_upto", "_state", *(f"_k{i}" for i in range(len(keys))))


accumulate_state_trace = stateful_output


def state_by_term(df: DataFrame, keys: list[str], term: str, order: list[str], ident: str) -> DataFrame:
    """Latest id of each named state entity."""
    return df.groupBy(*keys, term).agg(F.max_by(ident, F.struct(*order)).alias(ident))
