"""Merge overlapping intervals per entity and list the gaps, in two levels.

Level one clips every interval to time shards and merges inside each
(entity, shard), so an entity with a third of all rows is spread over its time
span. However long an interval, it gives at most two pieces, the parts in its
first and last shard, and one note that the whole shards between are covered.
Level two sees only what touches a shard boundary and the notes, at most a few
rows for each (entity, shard), a number bounded by the time span and not by
the rows; it stitches those and coalesces. Gaps work alike: inside a shard by
the next period, between shards by one row for each shard.

Result: the key columns, ``span`` (``period`` or ``gap``), ``from_ms``, ``to_ms``.
Rows with a null key column or bound, a bound that is not finite or whose
milliseconds do not fit 64 bits, or an end not after the start are no intervals. Times are seconds * 1000, rounded; an interval
that rounds to nothing is none either. Touching intervals join. Repeated rows
change nothing; an entity without intervals has no rows. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Width of a time shard. Any width gives the same result; an hour keeps the hot
#: entity of a busy log at some thousands of rows a shard.
SHARD_MS = 3_600_000

#: Just under the greatest 64-bit number, less a shard for its edges.
MOST_MS = 9.2e18


def _shard(col: str, width: int):
    """Number of the shard that holds a time, rounding down for times before 1970 too."""
    return F.expr(f"({col} - pmod({col}, {width}L)) div {width}L")


def _coalesce(pieces: DataFrame, group: list[str], *more) -> DataFrame:
    """Union of the intervals [a, z] of each group, as disjoint islands."""
    w = Window.partitionBy(*group).orderBy("a", "z")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("fresh", F.coalesce(F.col("a") > F.max("z").over(past), F.lit(True)).cast("int"))
        .withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "island")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"), *more)
        .drop("island")
    )


def merged_periods(df: DataFrame, keys: list[str], start: str, end: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """Continuous periods and gaps of each entity; see the module."""
    work = Scratch(df.sparkSession, "intervals")
    ks = [f"k{i}" for i in range(len(keys))]
    s, e = df[start].cast("double"), df[end].cast("double")
    ok = (e > s) & ~F.isnan(e) & (F.abs(s * 1000) < MOST_MS) & (F.abs(e * 1000) < MOST_MS)
    for k in keys:
        ok = ok & df[k].isNotNull()
    placed = (
        df.where(ok)
        .select(*(df[k].alias(x) for k, x in zip(keys, ks, strict=True)), F.round(s * 1000).cast("bigint").alias("a"), F.round(e * 1000).cast("bigint").alias("z"))
        .where("z > a")
        .withColumn("s0", _shard("a", shard_ms))
        .withColumn("s1", _shard("(z - 1)", shard_ms))
    )
    none = F.lit(None).cast("bigint")

    def piece(shard, a, z, to):
        return F.struct(shard.alias("shard"), a.alias("a"), z.alias("z"), to.alias("upto"))

    edge = lambda shard: shard * F.lit(shard_ms).cast("bigint")
    pieces = placed.select(
        *ks,
        F.explode(
            F.when(F.col("s0") == F.col("s1"), F.array(piece(F.col("s0"), F.col("a"), F.col("z"), none))).otherwise(
                F.array(
                    piece(F.col("s0"), F.col("a"), edge(F.col("s0") + 1), F.col("s1")),
                    piece(F.col("s1"), edge(F.col("s1")), F.col("z"), none),
                )
            )
        ).alias("p"),
    ).select(*ks, "p.*")

    # level one: islands inside each (entity, shard); upto: the last shard reached by an interval that starts here
    islands, _ = work.write(_coalesce(pieces, [*ks, "shard"], F.max("upto").alias("upto")))

    # level two
    touches = (F.col("a") == edge(F.col("shard"))) | (F.col("z") == edge(F.col("shard") + 1))
    between = F.col("upto") > F.col("shard") + 1
    fragments = islands.where(touches).select(*ks, "a", "z").unionByName(
        islands.where(between).select(*ks, edge(F.col("shard") + 1).alias("a"), edge(F.col("upto")).alias("z"))
    )
    stitched = _coalesce(fragments, ks)
    past = Window.partitionBy(*ks).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        islands.groupBy(*ks, "shard")
        .agg(F.max("upto").alias("upto"))
        .withColumn("reach", F.max("upto").over(past))
        .where("reach > shard")
        .select(*ks, "shard")
    )
    inner = islands.where(~touches).join(covered, [*ks, "shard"], "left_anti").select(*ks, "a", "z")
    periods, _ = work.write(inner.unionByName(stitched).withColumn("shard", _shard("a", shard_ms)))

    following = F.lead("a").over(Window.partitionBy(*ks, "shard").orderBy("a"))
    span = lambda name, a, z: F.struct(F.lit(name).alias("span"), a.alias("from_ms"), z.alias("to_ms"))
    within = periods.withColumn("next_a", following).select(
        *ks,
        F.explode(
            F.when(F.col("next_a").isNull(), F.array(span("period", F.col("a"), F.col("z")))).otherwise(
                F.array(span("period", F.col("a"), F.col("z")), span("gap", F.col("z"), F.col("next_a")))
            )
        ).alias("x"),
    ).select(*ks, "x.*")
    across = (
        periods.groupBy(*ks, "shard")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"))
        .withColumn("next_a", F.lead("a").over(Window.partitionBy(*ks).orderBy("shard")))
        .where("next_a is not null")
        .select(*ks, F.lit("gap").alias("span"), F.col("z").alias("from_ms"), F.col("next_a").alias("to_ms"))
    )
    return within.unionByName(across).select(*(F.col(x).alias(k) for x, k in zip(ks, keys, strict=True)), "span", "from_ms", "to_ms")
