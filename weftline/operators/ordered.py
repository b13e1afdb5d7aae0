"""Total order without a single task: positions and running aggregates, over all rows or per key.

A window without keys sends every row to one task, and one by key sends a key's
rows to one task, however many. Here rows are range-sorted over all executors by
(key, order), whatever the columns' types, and written; a window runs inside each
range, and a small table with one row for each (range, key) in it shifts local
results to global ones. A key with a third of all rows takes up a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_MAKE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """Written in order, with the range partition's number as ``_part``; rows equal in ``order`` share a range."""
    work = Scratch(df.sparkSession, "ordered")
    parted = df.repartitionByRange(*(F.col(c).asc() for c in order)).sortWithinPartitions(*order)
    return work.write(parted.withColumn("_part", F.spark_partition_id()))[0]


def with_position(df: DataFrame, order: list[str], column: str = "pos") -> tuple[DataFrame, int]:
    """Rows with their 0-based position in the order, and the number of rows."""
    held = _sorted(df, order)
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).sort("_part").collect()  # one row a partition
    before, starts = 0, []
    for r in counts:
        starts.append((r["_part"], before))
        before += r["n"]
    local = held.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    shift = df.sparkSession.createDataFrame(starts, "_part int, _before bigint")
    out = local.join(F.broadcast(shift), "_part").withColumn(column, (F.col("_rn") + F.col("_before")).cast("bigint"))
    return out.drop("_part", "_rn", "_before"), before


def running(df: DataFrame, order: list[str], aggregates: dict[str, tuple[str, str]], keys: list[str] = ()) -> DataFrame:
    """Running aggregates after every row, per key if there are keys: {name: (sum|count|min|max, column)}.

    Null keys are one key; null order values come first. Rows equal in the whole order follow each other in any order.
    """
    held = _sorted(df, [*keys, *order])
    w = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.select("*", *(_MAKE[f](c).over(w).alias(k) for k, (f, c) in aggregates.items()))
    state = held.groupBy(*keys, "_part").agg(*(_MAKE[f](c).alias(f"_s_{k}") for k, (f, c) in aggregates.items()))
    past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range and key
    state = state.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), *(_FOLD[f](f"_s_{k}").over(past).alias(f"_s_{k}") for k, (f, _) in aggregates.items())
    )
    out = local.join(state, [*(local[k].eqNullSafe(state[f"_k_{k}"]) for k in keys), local["_part"] == state["_p"]])
    for k, (f, _) in aggregates.items():
        a, b = F.col(k), F.col(f"_s_{k}")
        both = F.coalesce(a + b, a, b) if f in ("sum", "count") else (F.least(a, b) if f == "min" else F.greatest(a, b))
        out = out.withColumn(k, both)
    return out.drop("_part", "_p", *(f"_k_{k}" for k in keys), *(f"_s_{k}" for k in aggregates))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles per key, {name: share}, by linear interpolation at (n - 1) * share; one row a key.

    Equal values are counted together first, then ranked by a running count: no
    task holds a key's values. Null and NaN values are left out; null keys are one key.
    """
    x = F.col(value).cast("double")
    ks = [f"_g{i}" for i in range(len(keys))]
    each = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*(F.col(k).alias(g) for k, g in zip(keys, ks, strict=True)), x.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(each, ["_x"], {"_upto": ("sum", "_c")}, ks)
    whole = each.groupBy(*ks).agg(F.sum("_c").alias("_n")).select(*(F.col(g).alias(f"{g}_") for g in ks), "_n")
    placed = ranked.join(whole, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in ks]).drop(*(f"{g}_" for g in ks))
    here = lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto"))
    cols = []
    for name, p in shares.items():
        at = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.floor(at), F.ceil(at)
        cols += [F.max(F.when(here(lo), F.col("_x"))).alias(f"_lo_{name}"), F.max(F.when(here(hi), F.col("_x"))).alias(f"_hi_{name}"), F.max(at - lo).alias(f"_f_{name}")]
    out = placed.groupBy(*ks).agg(*cols)
    mid = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")
    return out.select(*(F.col(g).alias(k) for g, k in zip(ks, keys, strict=True)), *(mid(n).alias(n) for n in shares))
