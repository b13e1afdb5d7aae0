"""Exact and mergeable percentiles per group by radix selection.

Floating values map to 64-bit integers in the same order. A first pass counts,
for each group, how many values have each leading digit; the digit that holds a
target rank is all that the next pass looks into, digit after digit, until the
value is known to the last bit or to as many bits as asked for. No pass sorts
values, holds a group in one task or sends more than counts to another: a group
with a third of all rows is counted in every task and only its digit counts,
at most 2**16 for each digit followed, are brought together. After the first
pass the rows inside followed cells are written where they are, as integers, for
the later passes to read; they aren't shuffled either, unless the followed cells
are more than can be broadcast, and then by salted keys.

Error. With all 64 bits the order statistics are exact. With ``bits`` of them
the reported value is the lower edge of a cell; the true one lies in it, so for
normal numbers the relative error is below 2**(12 - bits) (``rel_error``).
:func:`digit_histogram` keeps such counts as a table: histograms of single days
or files are put together by :func:`merge_histograms` and give percentiles with
the same bound, whatever was merged in whichever order.

Values that are null, NaN or infinite are left out, and negative ones too where
``nonnegative``; so are rows whose group columns hold a null. Both zeros are one
value. Groups without values give no row. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

DIGIT = 16
#: A selection of so few (group, digit) cells is sent to all executors, some ten
#: megabytes at most; a larger one is met by a join on shuffled keys, with SALTS
#: parts of each key, for one group's cell may hold a third of all rows.
BROADCAST_CELLS = 150_000
SALTS = 32


def _view(kind: str):
    """The same 64 bits as another Arrow type: nothing is parsed or copied."""

    @F.arrow_udf({"bigint": "bigint", "double": "double"}[kind])
    def same_bits(x: pa.Array) -> pa.Array:
        return x.view(pa.int64() if kind == "bigint" else pa.float64())

    return same_bits


def order_key(x):
    """64-bit integer that orders as the double does."""
    bits = _view("bigint")(x + F.lit(0.0))
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def from_key(k):
    """The double of an :func:`order_key`."""
    return _view("double")(F.when(k < 0, k.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(k))


def rel_error(bits: int) -> float:
    """Bound of the relative error, of normal numbers, with so many bits followed."""
    return 0.0 if bits >= 64 else 2.0 ** (12 - bits)


def keyed(df: DataFrame, group: dict, value: str, nonnegative: bool = False) -> DataFrame:
    """Rows as (g0, g1, ..., key); ``group`` maps result names to columns."""
    x = df[value].cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    for g in group.values():
        ok = ok & g.isNotNull()
    if nonnegative:
        ok = ok & (x >= 0)
    return df.where(ok).select(*(g.alias(f"g{i}") for i, g in enumerate(group.values())), order_key(x).alias("key"))


def _targets(hist: DataFrame, gs: list[str], cell: list[str], qs: list[float], first: bool) -> DataFrame:
    """The cells that hold a target rank, with the ranks left to find inside them.

    ``hist`` has counts ``n`` by the columns ``cell + [digit]``. ``want`` are the
    0-based ranks sought inside each cell of ``cell``.
    """
    over = Window.partitionBy(*cell)
    run = over.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("before", F.sum("n").over(run) - F.col("n"))
    if first:
        h = h.withColumn("total", F.sum("n").over(over))
        ranks = []
        for q in qs:
            at = (F.col("total") - 1) * F.lit(q)
            ranks += [F.floor(at), F.ceil(at)]
        h = h.withColumn("want", F.array_distinct(F.array(*(r.cast("bigint") for r in ranks))))
    inside = F.filter("want", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    base = F.lit(0).cast("bigint") if first else F.col("base")
    return (
        h.withColumn("want", F.transform(inside, lambda r: r - F.col("before")))
        .where(F.size("want") > 0)
        .select(*gs, "digit", "total", "want", (base + F.col("before")).alias("base"))
    )


def _inside(rows_: DataFrame, targets: DataFrame, cells: int, gs: list[str]) -> DataFrame:
    """Rows in followed cells; ``rows_`` has a column cell."""
    wanted = targets.select(*gs, F.col("digit").alias("cell"))
    if cells <= BROADCAST_CELLS:
        return rows_.join(F.broadcast(wanted), [*gs, "cell"], "left_semi")
    every = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows_.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(_met(every, cells), [*gs, "cell", "salt"], "left_semi").drop("salt")


def _met(side: DataFrame, cells: int) -> DataFrame:
    """A join side made of the cells. Too many are never broadcast, though Spark may think them
    small: it goes by their compressed file and doesn't count the salted copies."""
    return side if cells <= BROADCAST_CELLS else side.hint("merge")


def percentiles(df: DataFrame, group: dict, value: str, qs: list[float], bits: int = 64, nonnegative: bool = False) -> DataFrame:
    """One row per group and percentile: group columns, ``n``, ``q``, ``lower``, ``upper``, ``value``.

    ``lower`` and ``upper`` are the order statistics next to rank (n-1)*q and
    ``value`` their linear interpolation.
    """
    work = Scratch(df.sparkSession, "radix")
    gs = [f"g{i}" for i in range(len(group))]
    rows_ = keyed(df, group, value, nonnegative)
    widths = [min(DIGIT, bits - b) for b in range(0, bits, DIGIT)]
    shift = 64 - widths[0]
    hist = rows_.groupBy(*gs, F.shiftright("key", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    targets, seen = work.write(_targets(hist, gs, gs, qs, True), cells=F.count(F.lit(1)))
    if len(widths) > 1:
        held, _ = work.write(_inside(rows_.withColumn("cell", F.shiftright("key", shift)), targets, seen["cells"], gs).drop("cell"))
        for width in widths[1:]:
            shift_up, shift = shift, shift - width
            at = _inside(held.withColumn("cell", F.shiftright("key", shift_up)), targets, seen["cells"], gs)
            sub = at.groupBy(*gs, "cell", F.shiftright("key", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
            known = targets.withColumnRenamed("digit", "cell")
            targets, seen = work.write(_targets(sub.join(_met(known, seen["cells"]), [*gs, "cell"]), gs, [*gs, "cell"], qs, False), cells=F.count(F.lit(1)))
    edge = from_key(F.shiftleft("digit", shift)) if shift else from_key(F.col("digit"))
    found = targets.select(*gs, "total", edge.alias("v"), F.explode("want").alias("r"), "base").withColumn("r", F.col("r") + F.col("base"))
    return _report(found.groupBy(*gs, "total").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at")), gs, list(group), qs)


def _report(ranks: DataFrame, gs: list[str], names: list[str], qs: list[float]) -> DataFrame:
    """``at`` maps the ranks of a group, two for each percentile, to their values."""
    each = ranks.select(*gs, F.col("total").alias("n"), "at", F.explode(F.array(*map(F.lit, qs))).alias("q")).withColumn("pos", (F.col("n") - 1) * F.col("q"))
    lower, upper = (F.element_at("at", f("pos").cast("bigint")) for f in (F.floor, F.ceil))
    return each.select(*gs, "n", "q", lower.alias("lower"), upper.alias("upper"), (lower + (upper - lower) * (F.col("pos") - F.floor("pos"))).alias("value")).withColumnsRenamed(dict(zip(gs, names, strict=True)))


def digit_histogram(df: DataFrame, group: dict, value: str, bits: int = 28, nonnegative: bool = False) -> DataFrame:
    """Mergeable summary: group columns, ``cell`` (the leading ``bits``), ``n``."""
    gs = [f"g{i}" for i in range(len(group))]
    h = keyed(df, group, value, nonnegative).groupBy(*gs, F.shiftright("key", 64 - bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumnsRenamed(dict(zip(gs, group, strict=True)))


def merge_histograms(parts: list[DataFrame], group: list[str]) -> DataFrame:
    """The histogram of all values that the parts count."""
    return reduce(DataFrame.unionByName, parts).groupBy(*group, "cell").agg(F.sum("n").alias("n"))


def histogram_percentiles(hist: DataFrame, group: list[str], qs: list[float], bits: int = 28) -> DataFrame:
    """Percentiles of a histogram, as :func:`percentiles`, within :func:`rel_error` of ``bits``."""
    gs = [f"g{i}" for i in range(len(group))]
    h = hist.withColumnsRenamed(dict(zip(group, gs, strict=True))).withColumnRenamed("cell", "digit")
    t = _targets(h, gs, gs, qs, True)
    found = t.select(*gs, "total", from_key(F.shiftleft("digit", 64 - bits)).alias("v"), F.explode("want").alias("r"), "base").withColumn("r", F.col("r") + F.col("base"))
    return _report(found.groupBy(*gs, "total").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at")), gs, group, qs)
